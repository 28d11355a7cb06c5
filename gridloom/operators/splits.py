"""Building leak-free splits: densities, hard sheets, stratified samples, negatives, quotas and checks.

Samples are ranked, not drawn: an order key (a column of small whole numbers, then the image) makes sizes exact and results the
same for any partitioning. Pass a hash as the key for a random sample, an arithmetic key for a repeatable one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.boxes import DENSITY, density_bin, density_order
from gridloom.operators.labels import tokens, whole_class
from gridloom.operators.ranks import ranked, running

FIRST_BIN = DENSITY[0][1]


def exact_rank(df: DataFrame, key: str, ties: Sequence[str], name: str = "rank", within: Sequence[str] = ()) -> DataFrame:
    """The rank (from 1) by (key, ties), over all rows or ``within`` equal values of some columns, for keys of any type and spread."""
    return ranked(df, [key, *ties], name, within)


def exact_quantile(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row (quantile) of a column of numbers, interpolated linearly between neighbours like ``percentile``.

    The values are counted, their counts summed up by range partitions and only the two that are wanted are taken: no task holds
    all distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, ["_value"], "_n", "_before").select("_value", "_n", (F.col("_before") + F.col("_n")).alias("_upto"))
    at = placed.agg(((F.sum("_n") - 1) * F.lit(float(share))).alias("_at"))  # one row
    low, high = F.floor("_at"), F.ceil("_at")
    found = placed.join(F.broadcast(at), (F.col("_upto") > low) & (F.col("_upto") - F.col("_n") <= high))
    pick = [F.min(F.when((F.col("_upto") > p) & (F.col("_upto") - F.col("_n") <= p), F.col("_value"))).alias(n) for n, p in (("_low", low), ("_high", high))]
    part = F.col("_at") - F.floor("_at")
    return found.groupBy("_at").agg(*pick).select(F.when(F.col("_low") == F.col("_high"), F.col("_low").cast("double")).otherwise((1 - part) * F.col("_low") + part * F.col("_high")).alias("quantile"))


def parse_tile_name(name: str | Column) -> tuple[Column, Column, Column]:
    """Sheet (the text before the first ``_``), row and column of a tile's name such as ``x12_s1_r1075_c0.jpg``."""
    name = F.col(name) if isinstance(name, str) else name
    return F.split(name, "_")[0], F.regexp_extract(name, r"_r(\d+)", 1).try_cast("long"), F.regexp_extract(name, r"_c(\d+)", 1).try_cast("long")


def load_analysis(raw: DataFrame) -> DataFrame:
    """Counts by image: the name without its extension, null counts as 0, and the density bin."""
    n = F.coalesce("num_panels", F.lit(0)).cast("long")
    return raw.select("image_id", F.regexp_replace("filename", r"\.(jpg|png)$", "").alias("name"), n.alias("num_panels"), density_bin(n).alias("bin"))


def assign_density(tiles: DataFrame, analysis: DataFrame) -> DataFrame:
    """Tiles with count and bin; tiles that the analysis lacks have 0 and the lowest bin."""
    out = tiles.join(analysis.select("image_id", "num_panels", "bin"), "image_id", "left")
    return out.fillna(0, ["num_panels"]).fillna(FIRST_BIN, ["bin"])


def sheet_stats(tiles: DataFrame, analysis: DataFrame) -> DataFrame:
    """Tiles, total, mean and largest density order of each sheet, over the tiles that the analysis has."""
    known = tiles.join(analysis.select("image_id", "num_panels", "bin"), "image_id")
    return known.groupBy("sheet").agg(F.count(F.lit(1)).alias("tiles"), F.sum("num_panels").alias("total"), (F.sum("num_panels") / F.count(F.lit(1))).alias("mean"), F.max(density_order(F.col("bin"))).alias("max_order"))


def hard_sheets(stats: DataFrame) -> DataFrame:
    """Sheets (one row each) ranked by largest density, then mean, then name."""
    return ranked(stats, [F.desc("max_order"), F.desc("mean"), F.col("sheet")]).withColumn("rank", F.col("rank").cast("int"))


def stress_sheets(stats: DataFrame, share: float = 0.12) -> DataFrame:
    """The hardest max(1, int(n x share)) sheets."""
    n = stats.agg(F.greatest(F.lit(1), (F.count(F.lit(1)) * share).cast("int")).alias("_n"))
    return hard_sheets(stats).join(F.broadcast(n), F.col("rank") <= F.col("_n")).select("sheet", "rank")  # one row


def stratified_sample(tiles: DataFrame, target: int, shares: Mapping[str, float], key: str, exclude: DataFrame | None = None, default: float = 0.2) -> DataFrame:
    """int(target x share) tiles of each bin, fewer if it has fewer; a shortfall is filled from the rest only if that is enough."""
    free = tiles if exclude is None else tiles.join(exclude.select("sheet"), "sheet", "left_anti")
    quota = F.lit(int(target * default))
    for name, share in shares.items():
        quota = F.when(F.col("bin") == name, int(target * share)).otherwise(quota)
    placed = exact_rank(free, key, ["image_id"], "_nth", within=["bin"]).withColumn("_in", F.col("_nth") <= quota)
    picked, rest = placed.where("_in").drop("_nth", "_in"), placed.where("NOT _in").drop("_nth", "_in")
    counts = placed.agg(F.count_if("_in").alias("_picked"), F.count_if(~F.col("_in")).alias("_left")).select((F.lit(target) - F.col("_picked")).alias("_short"), "_left")
    fill = exact_rank(rest, key, ["image_id"], "_rank").join(F.broadcast(counts), (F.col("_rank") <= F.col("_short")) & (F.col("_left") >= F.col("_short")))  # one row
    return picked.withColumn("filled", F.lit(False)).unionByName(fill.drop("_rank", "_short", "_left").withColumn("filled", F.lit(True)))


def hard_negatives(tiles: DataFrame, positive_sheets: DataFrame, files: DataFrame, lines: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Tiles of other sheets, of count 0, with a label file without a panel; the first ``most`` by ``key``, or all.

    ``lines`` are label lines (image_id, line). Of those with five tokens or more none may have the class 0, and none a class
    that is no whole number: such a file cannot be trusted. Shorter lines do not count.
    """
    cls = whole_class(F.get(tokens(), F.lit(0)))
    bad = lines.where((F.size(tokens()) >= 5) & (cls.isNull() | (cls == 0)))
    out = tiles.where("num_panels = 0").join(positive_sheets.select("sheet").distinct(), "sheet", "left_anti")
    out = out.join(files.select("image_id"), "image_id", "left_semi").join(bad.select("image_id"), "image_id", "left_anti")
    return out if most is None else out.orderBy(key, "image_id").limit(most)


def tile_areas(boxes: DataFrame) -> DataFrame:
    """Smallest area and number of the panels of each tile."""
    return boxes.groupBy("image_id").agg(F.min((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("min_area"), F.count(F.lit(1)).alias("panels"))


def small_ratio(areas: DataFrame) -> DataFrame:
    """Share of panels in tiles whose smallest panel is within the first quartile of the tiles' smallest panels; one row."""
    limit = exact_quantile(areas, "min_area", 0.25).withColumnRenamed("quantile", "p25")
    sums = areas.crossJoin(F.broadcast(limit)).groupBy("p25").agg(F.sum(F.when(F.col("min_area") <= F.col("p25"), F.col("panels")).otherwise(0)).alias("small"), F.sum("panels").alias("panels"))  # one row
    return sums.withColumn("ratio", F.when(F.col("panels") > 0, F.col("small") / F.col("panels")).otherwise(0.0))


def small_quota(selected: DataFrame, pool: DataFrame, quota: float = 0.25) -> DataFrame:
    """Tiles of the unselected ``pool`` to add so that small panels reach ``quota``: those of most panels first, until enough.

    Both tables have image_id, min_area and panels. A tile is added while fewer panels than needed come before it. What comes
    before is summed over the few distinct panel counts, then over ranks within one count, so no global window is needed.
    """
    state = small_ratio(selected).select("p25", F.when(F.col("ratio") < quota, (F.col("panels") * (F.lit(quota) - F.col("ratio"))).cast("int")).otherwise(0).alias("needed"))
    small = pool.join(selected.select("image_id"), "image_id", "left_anti").join(F.broadcast(state), F.col("min_area") <= F.col("p25"))  # one row
    by_count = small.groupBy("panels").agg((F.count(F.lit(1)) * F.col("panels")).alias("_sum"))
    ahead = Window.orderBy(F.desc("panels")).rowsBetween(Window.unboundedPreceding, -1)
    before = by_count.select("panels", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    ranked = exact_rank(small, "image_id", [], "_nth", within=["panels"]).join(before, "panels")
    return ranked.where(F.col("_before") + (F.col("_nth") - 1) * F.col("panels") < F.col("needed")).select("image_id", "min_area", "panels")


def rebalance(images: DataFrame, negatives: DataFrame, key: str, least: int = 50, most: int = 65, whole_sheets: bool = False) -> DataFrame:
    """Move min(most, max(least, n)) of the n negatives of train to val; with fewer than ``least`` nothing moves.

    A moved image can leave its sheet in both splits; with ``whole_sheets`` all images of its sheet move along.
    """
    train = images.where("split = 'train'").join(negatives.select("image_id"), "image_id", "left_semi")
    moved = train.orderBy(key, "image_id").limit(most).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where(F.col("_n") >= least)  # at most ``most`` rows
    on = "sheet" if whole_sheets else "image_id"
    marked = images.join(moved.select(on).distinct().withColumn("_moved", F.lit(True)), on, "left")
    return marked.withColumn("split", F.when(F.col("_moved"), "val").otherwise(F.col("split"))).drop("_moved")


def ratio_split(df: DataFrame, key: str, ratios: Sequence[tuple[str, float]], ties: Sequence[str] = ("image_id",)) -> DataFrame:
    """Exact shares by global rank: int(n x share) rows each, the last name takes the rest."""
    if abs(sum(r for _, r in ratios) - 1) > 0.01:
        raise ValueError("the ratios do not sum to 1")
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    ranked = exact_rank(df, key, ties, "_rank").crossJoin(F.broadcast(n))  # one row
    split, upto = None, F.lit(0)
    for name, share in ratios[:-1]:
        upto = upto + (F.col("_total") * share).cast("int")
        split = (split.when if split is not None else F.when)(F.col("_rank") <= upto, name)
    return ranked.withColumn("split", split.otherwise(ratios[-1][0])).drop("_rank", "_total")


def leakage(images: DataFrame) -> DataFrame:
    """Sheets in more than one split."""
    return images.groupBy("sheet").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("images")).where("splits > 1")


def split_summary(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images, empty and other ones, and the share of empty ones in each split."""
    some = boxes.select("image_id").distinct().withColumn("_some", F.lit(True))
    out = images.join(some, "image_id", "left").groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("_some").isNull()).alias("empty"), F.count_if(F.col("_some")).alias("filled"))
    return out.withColumn("negative_ratio", F.col("empty") / F.col("images"))


def build_splits(tiles: DataFrame, stress: DataFrame, positives: DataFrame, negatives: DataFrame, val: DataFrame) -> DataFrame:
    """Rows (image_id, sheet, split): the tiles of stress sheets, positives and negatives as train, and the val sample."""
    out = tiles.join(stress.select("sheet"), "sheet", "left_semi").select("image_id", "sheet", F.lit("stress").alias("split"))
    for part, name in ((positives, "train"), (negatives, "train"), (val, "val")):
        out = out.unionByName(part.select("image_id", "sheet", F.lit(name).alias("split")))
    return out.distinct()
