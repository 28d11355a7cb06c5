"""Folders of label files as a Python data source: listing and writing in tasks.

``spark.read.format("label_folder")`` lists a folder and all below it. Each task lists some of the first-level folders, one takes the
files that lie in the folder itself; nothing is listed by the driver but the names of first-level folders. Files of no bytes,
which DataFrame file sources pass over, are rows like all others: an empty label is a negative sample.

``df.write.format("label_folder")`` leaves one ``<image_id>.txt`` for each row. A task writes into a folder of its own, and the commit
moves the files of the successful attempts to their names, so a rerun task leaves no doubles and a failed job nothing.

Paths are what ``pyarrow.fs`` can open (local or mounted folders, s3, gs, hdfs); for others there is ``files.label_lines``.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "label_folder"
LISTED = "path string, stem string, ext string, size long"
STAGED = "_staged"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _below(where: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return where.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))


@dataclass
class Folders(InputPartition):
    paths: list[str]
    deep: bool


class FolderReader(DataSourceReader):
    """Options: path, and ``types``, extensions in lower case with commas between (all files without it)."""

    def __init__(self, options: dict):
        self.path, self.tasks = options["path"].rstrip("/"), int(options.get("tasks", "64"))
        self.types = set(filter(None, options.get("types", "").lower().split(",")))

    def partitions(self) -> list[Folders]:
        where, root = _opened(self.path)
        inner = sorted(f.path for f in _below(where, root) if f.type == fs.FileType.Directory and f.base_name != STAGED)
        dealt = [inner[i :: self.tasks] for i in range(min(self.tasks, len(inner)))]
        return [Folders([root], False), *(Folders(p, True) for p in dealt)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        where, left = _opened(self.path)[0], list(partition.paths)
        while left:
            for f in _below(where, left.pop()):
                if f.type == fs.FileType.Directory:
                    if partition.deep:
                        left.append(f.path)
                elif f.type == fs.FileType.File:
                    stem, _, ext = f.base_name.rpartition(".")
                    stem, ext = (stem, ext.lower()) if stem else (f.base_name, "")
                    if not self.types or ext in self.types:
                        yield f.path, stem, ext, f.size


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class FolderWriter(DataSourceWriter):
    """Rows (image_id, text); a null text is an empty file. With ``overwrite`` other .txt files of the folder go."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows) -> Staged:
        where, root = _opened(self.path)
        folder = f"{root}/{STAGED}/{self.job}/{uuid.uuid4().hex}"
        where.create_dir(folder, recursive=True)
        for row in rows:
            name = str(row["image_id"])
            if row["image_id"] is None or not name or "/" in name:
                raise ValueError(f"no file can have the name {row['image_id']!r}")
            with where.open_output_stream(f"{folder}/{name}.txt") as out:
                out.write((row["text"] or "").encode())
        return Staged(folder)

    def commit(self, messages) -> None:
        where, root = _opened(self.path)
        if self.overwrite:
            for f in _below(where, root):
                if f.type == fs.FileType.File and f.extension == "txt":
                    where.delete_file(f.path)
        for message in filter(None, messages):
            for f in _below(where, message.folder):
                where.move(f.path, posixpath.join(root, f.base_name))
        self._tidy(where, root)

    def abort(self, messages) -> None:
        self._tidy(*_opened(self.path))

    def _tidy(self, where: fs.FileSystem, root: str) -> None:
        where.delete_dir(f"{root}/{STAGED}/{self.job}")
        if not _below(where, f"{root}/{STAGED}"):
            where.delete_dir(f"{root}/{STAGED}")


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options, overwrite)


def label_files(spark: SparkSession, folder: str, types: str = "txt") -> DataFrame:
    """Rows (path, stem, ext, size) of the files below a folder, at any depth, empty ones too."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(NAME).option("types", types).load(folder)


def numbered_lines(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows (path, image_id, line_no, line) of listed files: physical line numbers from 1, blank lines left out.

    A file without a line is a row with a null line_no and line. Files are dealt to ``tasks`` by a hash of their paths, so that a
    single large folder is read by many.
    """

    def run(batches):
        for batch in batches:
            for path, stem in zip(batch["path"].to_pylist(), batch["stem"].to_pylist(), strict=True):
                where, at = _opened(path)
                with where.open_input_stream(at) as f:
                    lines = f.read().decode("utf-8", "replace").split("\n")
                held = [(n, line.rstrip("\r")) for n, line in enumerate(lines, 1) if line.strip()] or [(None, None)]
                numbers, texts = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array([stem] * len(held)), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["path", "image_id", "line_no", "line"])

    dealt = listed.select("path", "stem")
    dealt = dealt.repartition(tasks, "path") if tasks else dealt.repartition("path")
    return dealt.mapInArrow(run, "path string, image_id string, line_no int, line string")


def write_label_files(texts: DataFrame, folder: str, overwrite: bool = True) -> None:
    """One file ``<image_id>.txt`` for each image of ``texts`` (image_id, text); several rows of an image are lines, in order.

    An image whose texts are null or empty has an empty file.
    """
    texts.sparkSession.dataSource.register(FolderSource)
    whole = texts.groupBy(F.col("image_id").cast("string").alias("image_id")).agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    whole.write.format(NAME).mode("overwrite" if overwrite else "append").save(folder)
