"""Stitching: suppress, merge, cluster and filter the detections of an image.

The greedy operators shuffle once on the image and walk its boxes in the order (score descending, det_id) in one fold; after
that order is fixed nothing depends on partitioning. Merged corners are rounded to 1e-4 pixel, so that they do not depend on
the order of a sum either.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.boxes import CLIPPED, INCLUSIVE, aspect, inner_border, iou, short_side
from gridloom.operators.folds import unsuppressed

CORNERS = ("x1", "y1", "x2", "y2")
BOX = "struct<at:double,det_id:bigint,x1:double,y1:double,x2:double,y2:double,score:double>"
MEMBER = "struct<det_id:bigint,x1:double,y1:double,x2:double,y2:double,score:double,anchor:bigint>"
Edge = Callable[[Column, Column], Column]


def _of(box: Column) -> tuple:
    return tuple(box[c] for c in CORNERS)


def _walked(dets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each image's boxes as an array in walking order."""
    box = F.struct((-F.col("score")).cast("double").alias("at"), F.col("det_id").cast("long").alias("det_id"), *(F.col(c).cast("double").alias(c) for c in (*CORNERS, "score")))
    return dets.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def _unsuppressed(mode: str):
    @F.arrow_udf(f"array<{BOX}>")
    def kept(boxes: pa.Array, most: pa.Array) -> pa.Array:
        return unsuppressed(boxes, most, mode)

    return kept


def nms(dets: DataFrame, most: float | Column, mode: str = INCLUSIVE, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Boxes that no kept box of a higher score overlaps by more than ``most`` (a number or one of ``keys``); blind to classes."""

    # a generator hands the lists on once, whatever is read of them later
    walked = _walked(dets, keys).select(*keys, F.inline(F.array(F.struct("boxes", (most if isinstance(most, Column) else F.lit(most)).cast("double").alias("_most")))))
    return _kept(walked, mode, keys)


def _kept(walked: DataFrame, mode: str, keys: Sequence[str]) -> DataFrame:
    folded = walked.withColumn("boxes", _unsuppressed(mode)("boxes", "_most"))
    return folded.select(*keys, F.inline("boxes")).drop("at")


def nms_at(dets: DataFrame, values: Sequence[float], name: str, mode: str = INCLUSIVE, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``nms`` at each of ``values``, in a column ``name``: an image's boxes are gathered and put in order once."""
    each = F.explode(F.array(*(F.lit(float(v)) for v in values)))
    walked = _walked(dets, keys).select(*keys, "boxes", each.alias(name)).withColumn("_most", F.col(name))
    return _kept(walked, mode, [name, *keys])


def anchored(dets: DataFrame, edge: Edge, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Each box with the anchor that it joins: the first earlier anchor with an edge to it, else itself."""
    return _anchored(_walked(dets, keys), edge, keys)


def _anchored(walked: DataFrame, edge: Edge, keys: Sequence[str]) -> DataFrame:
    def step(seen, box):
        anchors = F.filter(seen, lambda s: (s["anchor"] == s["det_id"]) & edge(s, box))
        found = F.coalesce(F.get(anchors, F.lit(0))["det_id"], box["det_id"])
        return F.array_append(seen, F.struct(*(box[c].alias(c) for c in ("det_id", *CORNERS, "score")), found.alias("anchor")))

    folded = walked.select(*keys, F.aggregate("boxes", F.array().cast(f"array<{MEMBER}>"), step).alias("boxes"))
    return folded.select(*keys, F.inline("boxes"))


def _mean(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score-weighted mean corners of each anchor's boxes; plain means where all scores are 0."""
    weight = F.sum("score")
    corners = [F.round(F.when(weight > 0, F.sum(F.col(c) * F.col("score")) / weight).otherwise(F.avg(c)), 4).alias(c) for c in CORNERS]
    return members.groupBy(*keys, "anchor").agg(*corners, F.max("score").alias("score")).withColumnRenamed("anchor", "det_id")


def merge_iou_avg(dets: DataFrame, least: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Clusters of IoU (inclusive) at least ``least`` with their anchor, merged by score-weighted means."""
    return _mean(anchored(dets, lambda a, b: iou(_of(a), _of(b), INCLUSIVE) >= least, keys), keys)


def merge_minmax(dets: DataFrame, least: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """As ``merge_iou_avg``, but the merged box covers all members, so it never shrinks."""
    members = anchored(dets, lambda a, b: iou(_of(a), _of(b), INCLUSIVE) >= least, keys)
    ends = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    return members.groupBy(*keys, "anchor").agg(*ends, F.max("score").alias("score")).withColumnRenamed("anchor", "det_id")


def _radius(boxes: Column, ratio: float) -> Column:
    """``ratio`` x the median short side of an array of boxes."""
    sides = F.array_sort(F.transform(boxes, lambda b: F.least(b["x2"] - b["x1"], b["y2"] - b["y1"])))
    n = F.size(boxes)
    return F.get(F.transform(F.array(sides), lambda s: (F.get(s, ((n - 1) / 2).cast("int")) * 0.5 + F.get(s, (n / 2).cast("int")) * 0.5) * ratio), F.lit(0))


def _close(a, b, radius: Column) -> Column:
    """Whether the centres of two boxes lie within a radius, measured in radii."""
    dx, dy = ((a[f"{c}1"] / radius + a[f"{c}2"] / radius - b[f"{c}1"] / radius - b[f"{c}2"] / radius) / 2 for c in "xy")
    return dx * dx + dy * dy <= 1.0


def merge_center(dets: DataFrame, ratio: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Clusters whose centres lie within ``ratio`` x the image's median short side of their anchor's, merged by means.

    Boxes of an image whose median is 0 stay alone. One pass: the radius comes from the boxes that the walk gathers.
    """
    # a generator computes the radius once an image; as a plain column it would be inlined into the walk
    walked = _walked(dets, keys).select(*keys, F.inline(F.array(F.struct("boxes", _radius(F.col("boxes"), ratio).alias("_radius")))))
    near = F.when(F.col("_radius") > 0, F.col("_radius"))  # null: no edge
    return _mean(_anchored(walked, lambda a, b: F.coalesce(_close(a, b, near), F.lit(False)), keys), keys).select(*keys, "det_id", *CORNERS, "score")


def cluster_1d(df: DataFrame, value: Column, delta, keys: Sequence[str], tie: str, name: str = "cluster") -> DataFrame:
    """Gaps and islands: a new cluster starts where the gap to the next smaller value exceeds ``delta`` (number or column)."""
    along = Window.partitionBy(*keys).orderBy("_value", tie)
    opens = F.coalesce((F.col("_value") - F.lag("_value").over(along) > delta).cast("int"), F.lit(0))
    return df.withColumn("_value", value).withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(along)).drop("_value", "_opens")


def grid_dedup(dets: DataFrame, share: float = 0.5, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The best box of each cell of the grid that clustered centres form; ties go to the smaller det_id."""
    image = Window.partitionBy(*keys)
    sized = dets.withColumns({"_dx": F.greatest(F.lit(1.0), F.median(F.col("x2") - F.col("x1")).over(image) * share), "_dy": F.greatest(F.lit(1.0), F.median(F.col("y2") - F.col("y1")).over(image) * share)})
    cells = cluster_1d(sized, (F.col("x1") + F.col("x2")) / 2, F.col("_dx"), keys, "det_id", "col")
    cells = cluster_1d(cells, (F.col("y1") + F.col("y2")) / 2, F.col("_dy"), keys, "det_id", "row")
    best = F.row_number().over(Window.partitionBy(*keys, "row", "col").orderBy(F.desc("score"), "det_id"))
    return cells.withColumn("_nth", best).where("_nth = 1").select(*keys, "det_id", *CORNERS, "score")


def size_filter(dets: DataFrame, area_ratio: float, side_ratio: float, low: float, high: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Area and short side at least so many medians of the image (skipped where a median is 0), aspect in [low, high]."""
    image = Window.partitionBy(*keys)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    sized = dets.withColumns({"_area": area, "_side": short_side(CORNERS), "_aspect": aspect(CORNERS)})
    sized = sized.withColumns({"_ma": F.median("_area").over(image), "_ms": F.median("_side").over(image)})
    big = ((F.col("_ma") <= 0) | (F.col("_area") >= F.col("_ma") * area_ratio)) & ((F.col("_ms") <= 0) | (F.col("_side") >= F.col("_ms") * side_ratio))
    return sized.where(big & F.col("_aspect").between(low, high)).select(*dets.columns)


def iqr_filter(dets: DataFrame, k: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Width, height, area and aspect each within k interquartile ranges of the image's quartiles (linear interpolation)."""
    values = {"_w": F.col("x2") - F.col("x1"), "_h": F.col("y2") - F.col("y1"), "_area": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), "_aspect": aspect(CORNERS)}
    sized = dets.withColumns(values)
    image = Window.partitionBy(*keys)
    sized = sized.withColumns({f"{v}_q": F.percentile(F.col(v).cast("double"), [0.25, 0.75]).over(image) for v in values})
    kept = F.lit(True)
    for v in values:
        low, high = F.col(f"{v}_q")[0], F.col(f"{v}_q")[1]
        kept = kept & F.col(v).between(low - k * (high - low), high + k * (high - low))
    return sized.where(kept).select(*dets.columns)


def area_band(dets: DataFrame, low: float, high: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Area between ``low`` and ``high`` medians of the image."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    sized = dets.withColumn("_area", area).withColumn("_m", F.median("_area").over(Window.partitionBy(*keys)))
    return sized.where((F.col("_area") >= F.col("_m") * low) & (F.col("_area") <= F.col("_m") * high)).select(*dets.columns)


def in_inner_window(tile_dets: DataFrame, tile: int, overlap: float, frac: float) -> DataFrame:
    """Tile detections whose centre lies in the tile's inner window, borders included."""
    border = inner_border(F.lit(tile), overlap, frac)
    cx, cy = (F.col("lx1") + F.col("lx2")) / 2, (F.col("ly1") + F.col("ly2")) / 2
    return tile_dets.where(cx.between(border, F.lit(tile) - border) & cy.between(border, F.lit(tile) - border))


def untile(tile_dets: DataFrame, images: DataFrame) -> DataFrame:
    """Tile detections in the frame of their image, clipped to it; boxes without area go. det_id becomes unique by tile."""
    moved = tile_dets.join(images.select("image_id", "width", "height"), "image_id")
    for axis, side in (("x", "width"), ("y", "height")):
        for n in (1, 2):
            moved = moved.withColumn(f"{axis}{n}", F.least(F.greatest(F.col(f"l{axis}{n}") + F.col(f"t{axis}"), F.lit(0)), F.col(side)))
    return moved.where("x2 > x1 AND y2 > y1").select("image_id", "tx", "ty", "det_id", *CORNERS, "score")


def top_k(dets: DataFrame, k: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "det_id"))
    return dets.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")


def stitch(dets: DataFrame, merge_iou: float = 0.7, mode: str = "iou_avg", center_ratio: float = 0.3, area_ratio: float = 0.2, side_ratio: float = 0.2, low: float = 0.0, high: float = 9999.0, iqr_k: float | None = None, dedup: bool = False, offsets: DataFrame | None = None) -> DataFrame:
    """Suppress, merge, merge centres and filter, in this order; the interquartile band and the grid are off unless asked for.

    ``offsets`` (image_id, x_off, y_off) moves the boxes of images that were cut out of larger ones, as the last step.
    """
    out = nms(dets, merge_iou)
    if mode != "nms":
        out = (merge_minmax if mode == "minmax" else merge_iou_avg)(out, merge_iou)
    if center_ratio > 0:
        out = merge_center(out, center_ratio)
    out = size_filter(out, area_ratio, side_ratio, low, high)
    if iqr_k is not None:
        out = iqr_filter(out, iqr_k)
    out = grid_dedup(out) if dedup else out
    return out if offsets is None else shifted(out, offsets)


def shifted(dets: DataFrame, offsets: DataFrame) -> DataFrame:
    """Boxes moved by their image's (x_off, y_off); a missing one is 0."""
    by = offsets.select("image_id", F.coalesce("x_off", F.lit(0)).alias("_x"), F.coalesce("y_off", F.lit(0)).alias("_y"))
    moved = dets.join(by, "image_id", "left").fillna(0, ["_x", "_y"])
    return moved.withColumns({f"{a}{n}": F.col(f"{a}{n}") + F.col(f"_{a}") for a in "xy" for n in (1, 2)}).select(*dets.columns)


def stitch_training(dets: DataFrame, merge_iou: float = 0.7, center_ratio: float = 0.3, most: int = 300) -> DataFrame:
    """The trainer's way: clipped IoU in the suppression, covering merges, a cap on each image's boxes."""
    out = merge_minmax(nms(dets, merge_iou, CLIPPED), merge_iou)
    if center_ratio > 0:
        out = merge_center(out, center_ratio)
    return top_k(out, most)
