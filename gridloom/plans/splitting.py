"""Queries on splits and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.boxes import DENSITY_SQL, ORDER_SQL
from gridloom.operators import splits
from gridloom.plans.fixtures import ctes, view
from gridloom.plans.registry import Registry
from gridloom.sources.tables import written

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

TARGET, VAL_TARGET, NEGATIVES = 600, 150, 120
SHARES = {"<=2": 0.15, "3-5": 0.25, "6-10": 0.3, "11-15": 0.2, ">15": 0.1}
KEY = "(image_id * 7919) % 10007"
BASE = ctes("images", "analysis", "gt_boxes", "label_lines")
LOADED = f""", loaded AS (SELECT image_id, regexp_replace(filename, '\\.(jpg|png)$', '') AS name, CAST(coalesce(num_panels, 0) AS BIGINT) AS num_panels, {DENSITY_SQL.format('coalesce(num_panels, 0)')} AS bin FROM analysis),
tiles AS (SELECT i.image_id, i.sheet, i.split, {KEY.replace('image_id', 'i.image_id')} AS k, coalesce(l.num_panels, 0) AS num_panels, coalesce(l.bin, '<=2') AS bin FROM images i LEFT JOIN loaded l ON l.image_id = i.image_id)"""
STATS = f", stats AS (SELECT sheet, count(*) AS tiles, CAST(sum(l.num_panels) AS BIGINT) AS total, CAST(sum(l.num_panels) AS DOUBLE) / count(*) AS mean, max({ORDER_SQL.format('l.bin')}) AS max_order FROM images JOIN loaded l USING (image_id) GROUP BY sheet), ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY max_order DESC, mean DESC, sheet) AS INTEGER) AS rank FROM stats), stress AS (SELECT sheet, rank FROM ranked WHERE rank <= (SELECT greatest(1, CAST(trunc(count(*) * 0.12::DOUBLE) AS BIGINT)) FROM stats))"
ALL = BASE + LOADED + STATS


def _loaded(spark, sf_dir):
    return splits.load_analysis(view(spark, sf_dir, "analysis"))


def _tiles(spark, sf_dir):
    """Tiles with their bins, written once: the later steps of a split read them many times."""
    images = view(spark, sf_dir, "images").select("image_id", "sheet", "split", F.expr(KEY).alias("k"))
    return written(splits.assign_density(images, _loaded(spark, sf_dir)))


def _stats(spark, sf_dir):
    return splits.sheet_stats(view(spark, sf_dir, "images"), _loaded(spark, sf_dir))


@query("parse_tile_name", ctes("analysis") + r" SELECT image_id, string_split(filename, '_')[1] AS sheet, TRY_CAST(regexp_extract(filename, '_r(\d+)', 1) AS BIGINT) AS tile_y, TRY_CAST(regexp_extract(filename, '_c(\d+)', 1) AS BIGINT) AS tile_x FROM analysis")
def parse_tile_name(spark, sf_dir):
    sheet, row, col = splits.parse_tile_name("filename")
    return view(spark, sf_dir, "analysis").select("image_id", sheet.alias("sheet"), row.alias("tile_y"), col.alias("tile_x"))


@query("load_analysis", BASE + LOADED + " SELECT * FROM loaded")
def load_analysis(spark, sf_dir):
    return _loaded(spark, sf_dir)


@query("assign_density", BASE + LOADED + " SELECT image_id, sheet, split, num_panels, bin FROM tiles")
def assign_density(spark, sf_dir):
    return _tiles(spark, sf_dir).drop("k")


@query("sheet_stats", ALL + " SELECT * FROM stats")
def sheet_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query("hard_sheets", ALL + " SELECT * FROM ranked")
def hard_sheets(spark, sf_dir):
    return splits.hard_sheets(_stats(spark, sf_dir))


@query("stress_sheets", ALL + " SELECT * FROM stress")
def stress_sheets(spark, sf_dir):
    return splits.stress_sheets(_stats(spark, sf_dir))


def sample_ctes(out: str, split: str, target: int, exclude: str) -> str:
    quota = "CASE bin " + " ".join(f"WHEN '{b}' THEN {int(target * s)}" for b, s in SHARES.items()) + f" ELSE {int(target * 0.2)} END"
    return f""", {out}_r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY k, image_id) <= {quota} AS inn FROM tiles WHERE split = '{split}' AND sheet NOT IN ({exclude})),
{out}_c AS (SELECT {target} - count(*) FILTER (inn) AS short, count(*) FILTER (NOT inn) AS rest FROM {out}_r),
{out}_f AS (SELECT *, row_number() OVER (ORDER BY k, image_id) AS rn FROM {out}_r WHERE NOT inn),
{out} AS (SELECT image_id, sheet, split, num_panels, bin, FALSE AS filled FROM {out}_r WHERE inn UNION ALL SELECT image_id, sheet, split, num_panels, bin, TRUE FROM {out}_f, {out}_c WHERE rn <= short AND rest >= short)"""


SAMPLE = ALL + sample_ctes("picked", "train", TARGET, "SELECT sheet FROM stress")


def _picked(spark, sf_dir, tiles=None, stress=None):
    tiles, stress = tiles or _tiles(spark, sf_dir), stress or written(stress_sheets(spark, sf_dir))
    return written(splits.stratified_sample(tiles.where("split = 'train'"), TARGET, SHARES, "k", stress))


@query("stratified_sample", SAMPLE + " SELECT * FROM picked")
def stratified_sample(spark, sf_dir):
    return _picked(spark, sf_dir).drop("k")


#: Lines that rule a tile out: of five tokens or more, with the class 0 or one that is no whole number.
RULED_OUT = r"SELECT image_id FROM label_lines WHERE len(string_split_regex(trim(line), '\s+')) >= 5 AND (NOT regexp_full_match(string_split_regex(trim(line), '\s+')[1], '[+-]?[0-9]+') OR TRY_CAST(string_split_regex(trim(line), '\s+')[1] AS INTEGER) = 0)"
NEGATIVE = SAMPLE + f", negatives AS (SELECT image_id, sheet, split, num_panels, bin FROM tiles WHERE num_panels = 0 AND sheet NOT IN (SELECT sheet FROM stress) AND sheet NOT IN (SELECT sheet FROM picked) AND image_id % 11 <> 0 AND image_id NOT IN ({RULED_OUT}) ORDER BY k, image_id LIMIT {NEGATIVES})"


def _negatives(spark, sf_dir, tiles, stress, picked):
    tiles = tiles.join(stress.select("sheet"), "sheet", "left_anti")
    files = view(spark, sf_dir, "images").where("image_id % 11 <> 0")
    return written(splits.hard_negatives(tiles, picked, files, view(spark, sf_dir, "label_lines"), "k", NEGATIVES))


def _parts(spark, sf_dir):
    """The tables that a build goes through: tiles, stress sheets, positives and negatives."""
    tiles, stress = _tiles(spark, sf_dir), written(stress_sheets(spark, sf_dir))
    picked = _picked(spark, sf_dir, tiles, stress)
    return tiles, stress, picked, _negatives(spark, sf_dir, tiles, stress, picked)


@query("hard_negatives", NEGATIVE + " SELECT * FROM negatives")
def hard_negatives(spark, sf_dir):
    return _parts(spark, sf_dir)[3].select("image_id", "sheet", "split", "num_panels", "bin")


AREAS = ", areas AS (SELECT image_id, min((x2 - x1) * (y2 - y1)) AS min_area, count(*) AS panels FROM gt_boxes GROUP BY image_id)"
RATIO = "(SELECT p25, CAST(sum(CASE WHEN min_area <= p25 THEN panels ELSE 0 END) AS BIGINT) AS small, CAST(sum(panels) AS BIGINT) AS panels, CAST(sum(CASE WHEN min_area <= p25 THEN panels ELSE 0 END) AS DOUBLE) / sum(panels) AS ratio FROM {0}, (SELECT quantile_cont(min_area, 0.25) AS p25 FROM {0}) GROUP BY p25)"


@query("small_ratio", ctes("gt_boxes") + AREAS + " SELECT * FROM " + RATIO.format("areas"))
def small_ratio(spark, sf_dir):
    return splits.small_ratio(splits.tile_areas(view(spark, sf_dir, "gt_boxes")))


QUOTA = 0.6


@query("small_quota", SAMPLE + AREAS + f""", chosen AS (SELECT * FROM areas SEMI JOIN picked USING (image_id)), state AS (SELECT p25, CASE WHEN ratio < {QUOTA} THEN CAST(trunc(panels * ({QUOTA}::DOUBLE - ratio)) AS BIGINT) ELSE 0 END AS needed FROM {RATIO.format('chosen')}),
small AS (SELECT a.*, needed, coalesce(sum(panels) OVER (ORDER BY panels DESC, image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM areas a, state WHERE min_area <= p25 AND image_id NOT IN (SELECT image_id FROM picked)) SELECT image_id, min_area, panels FROM small WHERE before < needed""")
def small_quota(spark, sf_dir):
    areas = splits.tile_areas(view(spark, sf_dir, "gt_boxes"))
    return splits.small_quota(areas.join(_picked(spark, sf_dir).select("image_id"), "image_id", "left_semi"), areas, QUOTA)


REBALANCED = ", moved AS (SELECT image_id FROM images WHERE split = 'train' AND image_id NOT IN (SELECT image_id FROM gt_boxes) ORDER BY " + KEY + ", image_id LIMIT 65), rebalanced AS (SELECT image_id, sheet, CASE WHEN image_id IN (SELECT image_id FROM moved) AND (SELECT count(*) FROM moved) >= 50 THEN 'val' ELSE split END AS split FROM images)"


@query("rebalance_split", ctes("images", "gt_boxes") + REBALANCED + " SELECT * FROM rebalanced")
def rebalance_split(spark, sf_dir):
    images = view(spark, sf_dir, "images").select("image_id", "sheet", "split", F.expr(KEY).alias("k"))
    negatives = images.join(view(spark, sf_dir, "gt_boxes").select("image_id"), "image_id", "left_anti")
    return splits.rebalance(images, negatives, "k").select("image_id", "sheet", "split")


@query("split_leakage", ctes("images", "gt_boxes") + REBALANCED + " SELECT sheet, count(DISTINCT split) AS splits, count(*) AS images FROM rebalanced GROUP BY sheet HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    return splits.leakage(rebalance_split(spark, sf_dir))


BUILT = NEGATIVE + sample_ctes("vals", "val", VAL_TARGET, "SELECT sheet FROM stress UNION ALL SELECT sheet FROM picked UNION ALL SELECT sheet FROM negatives") + """, built AS (SELECT image_id, sheet, 'stress' AS split FROM tiles WHERE sheet IN (SELECT sheet FROM stress) UNION SELECT image_id, sheet, 'train' FROM picked UNION SELECT image_id, sheet, 'train' FROM negatives UNION SELECT image_id, sheet, 'val' FROM vals)"""


@query("build_splits", BUILT + " SELECT * FROM built")
def build_splits(spark, sf_dir):
    return _built(*_parts(spark, sf_dir))


def _built(tiles, stress, picked, negatives):
    taken = stress.select("sheet").unionByName(picked.select("sheet")).unionByName(negatives.select("sheet")).distinct()
    val = splits.stratified_sample(tiles.where("split = 'val'"), VAL_TARGET, SHARES, "k", taken)
    return splits.build_splits(tiles, stress, picked, negatives, val)


@query("density_by_split", BUILT + " SELECT b.split, t.bin, count(*) AS tiles FROM built b JOIN tiles t USING (image_id) GROUP BY b.split, t.bin")
def density_by_split(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    bins = parts[0].select("image_id", "bin")
    return _built(*parts).join(bins, "image_id").groupBy("split", "bin").agg(F.count(F.lit(1)).alias("tiles"))


@query("split_summary", ctes("images", "gt_boxes") + " SELECT split, count(*) AS images, count(*) FILTER (image_id NOT IN (SELECT image_id FROM gt_boxes)) AS empty, count(*) FILTER (image_id IN (SELECT image_id FROM gt_boxes)) AS filled, CAST(count(*) FILTER (image_id NOT IN (SELECT image_id FROM gt_boxes)) AS DOUBLE) / count(*) AS negative_ratio FROM images GROUP BY split")
def split_summary(spark, sf_dir):
    return splits.split_summary(view(spark, sf_dir, "images"), view(spark, sf_dir, "gt_boxes"))


@query("dataset_checks", BUILT + AREAS + f""", r AS (SELECT ratio FROM {RATIO.format('(SELECT * FROM areas SEMI JOIN picked USING (image_id))')}), n AS (SELECT count(*) FILTER (split = 'train') AS train, (SELECT count(*) FROM negatives) AS negatives, count(*) AS images FROM built), l AS (SELECT count(*) AS files FROM built WHERE image_id % 11 <> 0)
SELECT 'images_minus_labels' AS name, CAST(images - files AS DOUBLE) AS value, images = files AS ok FROM n, l UNION ALL SELECT 'negative_ratio', CAST(negatives AS DOUBLE) / train, CAST(negatives AS DOUBLE) / train BETWEEN 0.25 AND 0.30 FROM n UNION ALL SELECT 'small_ratio', ratio, ratio >= 0.25 FROM r""")
def dataset_checks(spark, sf_dir):
    tiles, stress, picked, chosen = _parts(spark, sf_dir)
    built = _built(tiles, stress, picked, chosen)
    counts = built.agg(F.count_if(F.col("split") == "train").alias("train"), F.count(F.lit(1)).alias("images"), F.count_if(F.col("image_id") % 11 != 0).alias("files"))
    negatives = chosen.agg(F.count(F.lit(1)).alias("negatives"))
    areas = splits.tile_areas(view(spark, sf_dir, "gt_boxes")).join(picked.select("image_id"), "image_id", "left_semi")
    one = counts.crossJoin(F.broadcast(negatives)).crossJoin(F.broadcast(splits.small_ratio(areas).select("ratio")))  # one row each
    share = F.col("negatives") / F.col("train")
    rows = [("images_minus_labels", (F.col("images") - F.col("files")).cast("double"), F.col("images") == F.col("files")), ("negative_ratio", share, share.between(0.25, 0.30)), ("small_ratio", F.col("ratio"), F.col("ratio") >= 0.25)]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), ok.alias("ok")) for n, v, ok in rows])))


@query("sample_pairs", ctes("images", "gt_boxes") + f" SELECT image_id, sheet FROM images WHERE image_id IN (SELECT image_id FROM gt_boxes) ORDER BY {KEY}, image_id LIMIT 25")
def sample_pairs(spark, sf_dir):
    pairs = view(spark, sf_dir, "images").join(view(spark, sf_dir, "gt_boxes").select("image_id"), "image_id", "left_semi")
    return pairs.orderBy(F.expr(KEY), "image_id").limit(25).select("image_id", "sheet")


@query("ratio_split", ctes("images") + f", r AS (SELECT image_id, row_number() OVER (ORDER BY {KEY}, image_id) AS rn, count(*) OVER () AS n FROM images) SELECT image_id, CASE WHEN rn <= trunc(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= trunc(n * 0.7::DOUBLE) + trunc(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r")
def ratio_split(spark, sf_dir):
    images = view(spark, sf_dir, "images").select("image_id", F.expr(KEY).alias("k"))
    return splits.ratio_split(images, "k", [("train", 0.7), ("val", 0.2), ("test", 0.1)]).select("image_id", "split")
