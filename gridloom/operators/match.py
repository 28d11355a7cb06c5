"""One-to-one matching of detections to ground truth."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.boxes import CONTINUOUS, INCLUSIVE, iou
from gridloom.operators.folds import unmatched_before

PAIR = "array<struct<iou:double,det_id:bigint,box_id:bigint>>"
CORNERS = ("x1", "y1", "x2", "y2")


def candidate_pairs(preds: DataFrame, gts: DataFrame, least: float, keys: Sequence[str] = ("image_id",), mode: str = CONTINUOUS, carry: Sequence[str] = (), corners: bool = False) -> DataFrame:
    """Detection x truth pairs within an image whose IoU is at least ``least`` (over 0).

    ``carry`` names further columns of ``preds`` that a pair keeps; with ``corners`` it keeps both boxes (p_x1, ..., g_y2). An
    equi-join on ``keys`` with the overlap test in the join condition. For images of thousands of boxes use
    ``candidate_pairs_by_cell``, which also splits an image.
    """
    p, g = preds.alias("p"), gts.alias("g")
    touch = 1 if mode == INCLUSIVE else 0
    near = [F.col(f"p.{k}") == F.col(f"g.{k}") for k in keys]
    near += [F.col("p.x1") < F.col("g.x2") + touch, F.col("g.x1") < F.col("p.x2") + touch, F.col("p.y1") < F.col("g.y2") + touch, F.col("g.y1") < F.col("p.y2") + touch]
    value = iou(tuple(f"p.{c}" for c in CORNERS), tuple(f"g.{c}" for c in CORNERS), mode)
    boxes = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "pg" for c in CORNERS] if corners else []
    return p.join(g, near).select(*(f"p.{k}" for k in (*carry, *keys)), "p.det_id", "g.box_id", "p.score", value.alias("iou"), *boxes).where((F.col("iou") >= least) & (F.col("iou") > 0))


def candidate_pairs_by_cell(preds: DataFrame, gts: DataFrame, least: float, cell: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """``candidate_pairs`` for images with very many boxes: each box goes to the grid cells that it covers.

    A pair is kept only in the cell of the top left corner of its intersection, so no duplicates have to be removed.
    """

    def spread(df):
        def cells(a, b):
            return F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))

        return df.select("*", cells("x1", "x2").alias("gx")).select("*", cells("y1", "y2").alias("gy"))

    p, g = spread(preds).alias("p"), spread(gts).alias("g")
    near = [F.col(f"p.{k}") == F.col(f"g.{k}") for k in (*keys, "gx", "gy")]
    near += [F.col("p.x1") < F.col("g.x2"), F.col("g.x1") < F.col("p.x2"), F.col("p.y1") < F.col("g.y2"), F.col("g.y1") < F.col("p.y2")]
    near += [F.floor(F.greatest("p.x1", "g.x1") / cell) == F.col("p.gx"), F.floor(F.greatest("p.y1", "g.y1") / cell) == F.col("p.gy")]
    value = iou(tuple(f"p.{c}" for c in CORNERS), tuple(f"g.{c}" for c in CORNERS))
    return p.join(g, near).select(*(f"p.{k}" for k in keys), "p.det_id", "g.box_id", "p.score", value.alias("iou")).where((F.col("iou") >= least) & (F.col("iou") > 0))


def _taken(pairs: str):
    @F.arrow_udf(PAIR)  # its type is read by the session
    def taken(pairs: pa.Array) -> pa.Array:
        return unmatched_before(pairs)

    return taken(pairs)


def greedy_matches(pairs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The pairs that a greedy pass takes: highest (iou, det_id, box_id) first, each box of either side once.

    One shuffle on ``keys``; a fold over each image's pairs keeps those that meet no earlier one.
    """
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("iou", F.col("det_id").cast("long").alias("det_id"), F.col("box_id").cast("long").alias("box_id")))))

    folded = pairs.groupBy(*keys).agg(ordered.alias("pairs")).select(*keys, F.explode(F.array("pairs")).alias("pairs")).withColumn("pairs", _taken("pairs"))
    return folded.select(*keys, F.inline("pairs")).select(*keys, "det_id", "box_id", "iou")


def mutual_best_matches(pairs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The same matches by rounds, for images of very many pairs: pairs that are best for both sides are taken, their rows go.

    Each round is written out to cut the lineage. As the order is strict and total, the set equals the greedy pass's.
    """
    from gridloom.sources.tables import written

    taken, left = None, written(pairs.select(*keys, "det_id", "box_id", "iou"))
    while not left.isEmpty():
        rank = F.struct("iou", "det_id", "box_id")
        by_det = left.groupBy(*keys, "det_id").agg(F.max(rank).alias("d")).select(*keys, "d.*")
        by_box = left.groupBy(*keys, "box_id").agg(F.max(rank).alias("b")).select(*keys, "b.*")
        both = by_det.join(by_box, [*keys, "det_id", "box_id", "iou"])
        both = written(both)
        taken = both if taken is None else taken.unionByName(both)
        left = left.join(both.select(*keys, "det_id"), [*keys, "det_id"], "left_anti").join(both.select(*keys, "box_id"), [*keys, "box_id"], "left_anti")
        left = written(left.select(*keys, "det_id", "box_id", "iou"))
    return left if taken is None else taken


def match_status(preds: DataFrame, gts: DataFrame, matches: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Rows (keys, status, det_id, box_id, iou): matched pairs, unmatched detections and unmatched truth."""
    lone = preds.join(matches, [*keys, "det_id"], "left_anti").select(*keys, F.lit("unmatched_pred").alias("status"), "det_id", F.lit(None).cast("long").alias("box_id"), F.lit(None).cast("double").alias("iou"))
    missed = gts.join(matches, [*keys, "box_id"], "left_anti").select(*keys, F.lit("unmatched_gt").alias("status"), F.lit(None).cast("long").alias("det_id"), "box_id", F.lit(None).cast("double").alias("iou"))
    return matches.select(*keys, F.lit("matched").alias("status"), "det_id", "box_id", "iou").unionByName(lone).unionByName(missed)
