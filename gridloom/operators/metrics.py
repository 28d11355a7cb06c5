"""Recall, precision and false positives from matches, over images, density bins, small objects and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.boxes import density_bin, density_order
from gridloom.operators.match import candidate_pairs, greedy_matches
from gridloom.operators.splits import exact_quantile

#: Where nothing is known of an image's density.
UNKNOWN_BIN = "6-10"


def at_thresholds(df: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    """Every row once for each threshold: a generator, so no join is needed."""
    return df.select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name), "*")


def image_counts(images: DataFrame, gts: DataFrame, preds: DataFrame, matches: DataFrame, keys: Sequence[str] = ("image_id",), small: DataFrame | None = None) -> DataFrame:
    """Rows (keys, tp, fp, fn, n_gt, n_pred): one for each row of ``images``, which has all of ``keys``; nothing found gives 0.

    With ``small`` (image_id, box_id), a column small_tp counts the matches of these truth boxes.
    """
    keys = list(keys)
    gt_keys = [k for k in keys if k in gts.columns]
    n_gt = gts.groupBy(*gt_keys).agg(F.count(F.lit(1)).alias("n_gt"))
    n_pred = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pred"))
    tp = [F.count(F.lit(1)).alias("tp")]
    if small is not None:
        matches, tp = matches.join(small.select("image_id", "box_id", F.lit(1).alias("_small")), ["image_id", "box_id"], "left"), [*tp, F.count("_small").alias("small_tp")]
    tp = matches.groupBy(*keys).agg(*tp)
    out = images.join(n_gt, gt_keys, "left").join(n_pred, keys, "left").join(tp, keys, "left").fillna(0)
    return out.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})


def totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall, precision, false positives and detections an image from per-image counts."""
    sums = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("images"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "n_gt", "n_pred")))
    return _rates(sums, by)


def _rates(sums: DataFrame, by: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    return sums.select(
        *by, *more, "images", "tp", "fp", "fn",
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"),
        (F.col("fp") / F.greatest("images", F.lit(1))).alias("fp_per_image"), (F.col("n_pred") / F.greatest("images", F.lit(1))).alias("preds_per_image"),
    )


def with_bins(counts: DataFrame, analysis: DataFrame) -> DataFrame:
    """Add each image's density bin; images that ``analysis`` (image_id, num_panels) lacks are taken as ``UNKNOWN_BIN``."""
    bins = analysis.select("image_id", density_bin(F.coalesce("num_panels", F.lit(0))).alias("bin"))
    return counts.join(bins, "image_id", "left").withColumn("bin", F.coalesce("bin", F.lit(UNKNOWN_BIN)))


def bin_metrics(binned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = binned.groupBy(*by, "bin").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_gt")))
    return sums.withColumn("recall", F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt")))


def worst_bin(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The bin of least recall among bins with truth and a recall under 1, the first in bin order on ties; else (1.0, null)."""
    found = bins.groupBy(*by).agg(_worst().alias("w"))
    return found.select(*by, F.coalesce("w.recall", F.lit(1.0)).alias("worst_bin_recall"), F.col("w.bin").alias("worst_bin"))


def _worst() -> Column:
    low = (F.col("n_gt") > 0) & (F.col("recall") < 1.0)
    return F.min(F.when(low, F.struct("recall", density_order(F.col("bin")).alias("at"), "bin")))


def small_truth(gts: DataFrame) -> DataFrame:
    """Truth (image_id, box_id) whose area is at most the first quartile of all truth (linear interpolation)."""
    sized = box_areas(gts)
    return sized.join(F.broadcast(exact_quantile(sized, "area", 0.25)), F.col("area") <= F.col("quantile")).select("image_id", "box_id")  # one row


def box_areas(gts: DataFrame) -> DataFrame:
    return gts.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))


def small_recall(gts: DataFrame, matches: DataFrame, by: Sequence[str] = (), values: DataFrame | None = None) -> DataFrame:
    """Recall over ``small_truth``.

    ``values``: one row for each setting of ``by``, so that a setting without matches is reported too.
    """
    small = small_truth(gts)
    total = small.agg(F.count(F.lit(1)).alias("small_gt"))
    found = matches.join(small, ["image_id", "box_id"], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("small_tp"))
    base = values.join(found, list(by), "left") if by else found
    out = base.fillna(0, ["small_tp"]).crossJoin(F.broadcast(total))  # one row
    return out.select(*by, "small_tp", "small_gt", (F.col("small_tp") / F.greatest("small_gt", F.lit(1))).alias("small_recall"))


def sweep(images: DataFrame, gts: DataFrame, scored: DataFrame, pairs: DataFrame, analysis: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """One row for each threshold: totals, worst bin and small-object recall, from one pass over the matches.

    ``scored`` and ``pairs`` carry the threshold column ``name``: the detections and the candidate pairs that count at it.
    """
    small = small_truth(gts)
    every = at_thresholds(images.select("image_id"), values, name)
    counts = image_counts(every, gts, scored, greedy_matches(pairs, [name, "image_id"]), [name, "image_id"], small)
    summed = ("tp", "fp", "fn", "n_gt", "n_pred", "small_tp")
    bins = with_bins(counts, analysis).groupBy(name, "bin").agg(F.count(F.lit(1)).alias("images"), *(F.sum(c).alias(c) for c in summed))
    bins = bins.withColumn("recall", F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt")))
    whole = bins.groupBy(name).agg(*(F.sum(c).alias(c) for c in ("images", *summed)), _worst().alias("w"))
    whole = whole.withColumns({"worst_bin_recall": F.coalesce("w.recall", F.lit(1.0)), "worst_bin": F.col("w.bin")}).drop("w")
    out = _rates(whole, [name], ["worst_bin_recall", "worst_bin", "small_tp"]).crossJoin(F.broadcast(small.agg(F.count(F.lit(1)).alias("small_gt"))))  # one row
    return out.withColumn("small_recall", F.col("small_tp") / F.greatest("small_gt", F.lit(1)))


def conf_sweep(images: DataFrame, gts: DataFrame, preds: DataFrame, analysis: DataFrame, confs: Sequence[float], least: float = 0.4) -> DataFrame:
    """Pairs are found once at the lowest score and then dealt to the thresholds they pass."""
    pairs = candidate_pairs(preds.where(F.col("score") >= min(confs)), gts, least)
    return sweep(images, gts, at_thresholds(preds, confs, "conf").where("score >= conf"), at_thresholds(pairs, confs, "conf").where("score >= conf"), analysis, "conf", confs)


def near_miss_bins(gts: DataFrame, matches: DataFrame, hit: float = 0.4) -> DataFrame:
    """Each truth box as hit (matched at ``hit`` or more), near (matched below) or miss."""
    met = matches.select("image_id", "box_id", "iou")
    return gts.select("image_id", "box_id").join(met, ["image_id", "box_id"], "left").withColumn("kind", F.when(F.col("iou") >= hit, "hit").when(F.col("iou").isNotNull(), "near").otherwise("miss"))


def top_by_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each partition before the shuffle."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= k).drop("_nth")
