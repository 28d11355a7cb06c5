"""Files as tables: inventories, label files with their line numbers, manifests and images."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
#: Folders that earlier runs wrote.
OUTPUT_FOLDERS = r"/(pred|pdf_pages|run_[^/]*|pred_[^/]*)/"

MANIFEST = "image string, src_label string, roi_image string, roi_label string, bbox struct<x0:int,y0:int,x1:int,y1:int>, scale double, mask_coverage double, src_box_count int, kept_box_count int, remap_note string"


def inventory(spark: SparkSession, folder: str, types: Sequence[str] = IMAGE_TYPES) -> DataFrame:
    """Rows (path, length, stem, ext) of the files below a folder; their contents are not read. Empty files are not listed."""
    return listed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length"), types)


def listed(found: DataFrame, types: Sequence[str] = IMAGE_TYPES) -> DataFrame:
    """Rows (path, length, stem, ext) of those paths that have one of the extensions, in any case, and lie in no output folder."""
    name = F.element_at(F.split("path", "/"), -1)
    out = found.withColumns({"stem": F.regexp_replace(name, r"\.[^.]*$", ""), "ext": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})
    return out.where(F.col("ext").isin(*types) & ~F.col("path").rlike(OUTPUT_FOLDERS))


def label_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, stem, size) of all label files, the empty ones too: an empty label is a negative sample.

    DataFrame sources leave files of no bytes out, so this one asks the file system for names and sizes; contents are not read.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, "*.txt"))
    out = spark.createDataFrame([(f.getPath().toString(), f.getLen()) for f in found or []], "path string, size long")
    return out.withColumn("stem", F.regexp_extract("path", r"([^/]*)\.txt$", 1))


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (image_id, line_no, line) of label files: physical line numbers from 1, blank lines left out. image_id is the stem."""
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    return lines_of(text.select(F.col("_metadata.file_name").alias("file"), "value"))


def lines_of(files: DataFrame) -> DataFrame:
    parts = files.select(F.regexp_replace("file", r"\.txt$", "").alias("image_id"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return parts.where(F.trim("line") != "").select("image_id", (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records of a region manifest (JSON lines); blank lines and records that lack a path, or have an empty one, go."""
    return spark.read.schema(MANIFEST).json(path).where("image != '' AND roi_image != '' AND roi_label != ''")


def pixels(images: DataFrame) -> DataFrame:
    """Rows (image_id, x, y, r, g, b) of images read by Spark's ``image`` source (bytes in the order B, G, R)."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for name, h, w, c, data in zip(frame["origin"], frame["height"], frame["width"], frame["nChannels"], frame["data"], strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, c)
                a = a.repeat(3, axis=2) if c == 1 else a
                y, x = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"image_id": name, "x": x, "y": y, **{k: a[:, :, i].reshape(-1).astype("int64") for i, k in ((2, "r"), (1, "g"), (0, "b"))}})

    return images.select("image.*").mapInPandas(run, "image_id string, x long, y long, r long, g long, b long")


def downscale_factor(height, width, most: int):
    """The factor that brings the longer side to ``most`` pixels; 1 for smaller images."""
    side = F.greatest(height, width)
    return F.when(side > most, F.lit(float(most)) / side).otherwise(F.lit(1.0))


def score_images(images: DataFrame, score: Callable) -> DataFrame:
    """The hook for a detector: ``score`` maps an iterator of pandas frames to frames of the fixed output columns."""
    return images.mapInPandas(score, "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double, cls int")
