"""Queries on matching and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.boxes import CLIPPED, CONTINUOUS, DENSITY_SQL, INCLUSIVE, ORDER_SQL
from gridloom.operators import match, metrics, stitch
from gridloom.plans.fixtures import ctes, view
from gridloom.plans.registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

CONF, LEAST, NEAR = 0.25, 0.4, 0.2
CONFS = [0.05, 0.10, 0.20, 0.30, 0.40]
IOUS = [0.20, 0.30, 0.40, 0.50]


def _shared(a, b, more=""):
    w = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1){more})"
    return f"CAST({w} * {w.replace('x1', 'y1').replace('x2', 'y2')} AS DOUBLE)"


def _area(a, more=""):
    return f"({a}.x2 - {a}.x1{more}) * ({a}.y2 - {a}.y1{more})"


def iou_sql(a: str, b: str, mode: str = CONTINUOUS) -> str:
    """IoU of two aliased boxes that overlap or touch."""
    if mode == INCLUSIVE:
        s = _shared(a, b, " + 1")
        return f"({s} / (CAST({_area(a, ' + 1')} + {_area(b, ' + 1')} AS DOUBLE) - {s} + 1e-6))"
    s = _shared(a, b)
    if mode == CLIPPED:
        return f"({s} / (CAST({_area(a)} + {_area(b)} AS DOUBLE) - {s} + 1e-9))"
    return f"({s} / (CAST({_area(a)} + {_area(b)} AS DOUBLE) - {s}))"


TOUCH = "p.x1 < g.x2 AND g.x1 < p.x2 AND p.y1 < g.y2 AND g.y1 < p.y2"


def pairs_sql(least: float, conf: float | None) -> str:
    score = f" AND p.score >= {conf}" if conf is not None else ""
    return f"SELECT p.image_id, p.det_id, g.box_id, p.score, {iou_sql('p', 'g')} AS iou FROM pred_boxes p JOIN gt_boxes g ON p.image_id = g.image_id AND {TOUCH}{score} WHERE {iou_sql('p', 'g')} >= {least}"


def walk_sql(pairs: str, key: str = "") -> str:
    """CTEs after ``pairs``: ``matched`` is what the greedy pass takes, by image and ``key``."""
    k, on = (f"{key}, ", f"w.{key} = n.{key} AND ") if key else ("", "")
    pk = f"n.{key}, " if key else ""
    free = "NOT list_contains(w.dets, n.det_id) AND NOT list_contains(w.boxes, n.box_id)"
    return f"""numbered AS (SELECT {k}image_id, det_id, box_id, iou, row_number() OVER (PARTITION BY {k}image_id ORDER BY iou DESC, det_id DESC, box_id DESC) AS rn FROM {pairs}),
walk AS (SELECT {k}image_id, rn, [det_id] AS dets, [box_id] AS boxes, TRUE AS taken FROM numbered WHERE rn = 1
 UNION ALL SELECT {pk}n.image_id, n.rn, CASE WHEN {free} THEN list_append(w.dets, n.det_id) ELSE w.dets END, CASE WHEN {free} THEN list_append(w.boxes, n.box_id) ELSE w.boxes END, {free}
 FROM walk w JOIN numbered n ON {on}w.image_id = n.image_id AND n.rn = w.rn + 1),
matched AS (SELECT {pk}n.image_id, n.det_id, n.box_id, n.iou FROM walk w JOIN numbered n ON {on}w.image_id = n.image_id AND w.rn = n.rn WHERE w.taken)"""


def _base(spark, sf_dir):
    return view(spark, sf_dir, "gt_boxes"), view(spark, sf_dir, "pred_boxes")


def _matched(spark, sf_dir, least=LEAST, conf=CONF):
    gts, preds = _base(spark, sf_dir)
    preds = preds.where(F.col("score") >= conf)
    return gts, preds, match.greedy_matches(match.candidate_pairs(preds, gts, least))


MATCHED = ctes("gt_boxes", "pred_boxes", "images", "analysis") + f", pairs AS ({pairs_sql(LEAST, CONF)}), {walk_sql('pairs')}"
COUNTS = f""", counts AS (SELECT i.image_id, coalesce(g.n, 0) AS n_gt, coalesce(p.n, 0) AS n_pred, coalesce(m.n, 0) AS tp, coalesce(p.n, 0) - coalesce(m.n, 0) AS fp, coalesce(g.n, 0) - coalesce(m.n, 0) AS fn, i.sheet, i.split
FROM images i LEFT JOIN (SELECT image_id, count(*) AS n FROM gt_boxes GROUP BY image_id) g ON g.image_id = i.image_id
LEFT JOIN (SELECT image_id, count(*) AS n FROM pred_boxes WHERE score >= {CONF} GROUP BY image_id) p ON p.image_id = i.image_id
LEFT JOIN (SELECT image_id, count(*) AS n FROM matched GROUP BY image_id) m ON m.image_id = i.image_id)"""
TOTALS = """count(*) AS images, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
CAST(sum(tp) AS DOUBLE) / greatest(sum(tp) + sum(fn), 1) AS recall, CAST(sum(tp) AS DOUBLE) / greatest(sum(tp) + sum(fp), 1) AS precision,
CAST(sum(fp) AS DOUBLE) / greatest(count(*), 1) AS fp_per_image, CAST(sum(n_pred) AS DOUBLE) / greatest(count(*), 1) AS preds_per_image"""


def binned_sql(counts: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f""", binned AS (SELECT {k}coalesce({DENSITY_SQL.format('a.n')}, '6-10') AS bin, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(n_gt) AS BIGINT) AS n_gt
FROM {counts} c LEFT JOIN (SELECT image_id, coalesce(num_panels, 0) AS n FROM analysis) a ON a.image_id = c.image_id GROUP BY ALL),
binned_recall AS (SELECT *, CASE WHEN n_gt > 0 THEN CAST(tp AS DOUBLE) / n_gt END AS recall FROM binned)"""


@query("iou_pairs", ctes("gt_boxes", "pred_boxes") + f" SELECT p.image_id, p.det_id, g.box_id, {iou_sql('p', 'g')} AS iou, {iou_sql('p', 'g', INCLUSIVE)} AS iou_inclusive, {iou_sql('p', 'g', CLIPPED)} AS iou_clipped FROM pred_boxes p JOIN gt_boxes g ON p.image_id = g.image_id AND {TOUCH} WHERE p.score >= {CONF}")
def iou_pairs(spark, sf_dir):
    gts, preds = _base(spark, sf_dir)
    pairs = match.candidate_pairs(preds.where(F.col("score") >= CONF), gts, 0.0, corners=True)
    boxes = tuple(f"p_{c}" for c in match.CORNERS), tuple(f"g_{c}" for c in match.CORNERS)
    return pairs.select("image_id", "det_id", "box_id", "iou", match.iou(*boxes, INCLUSIVE).alias("iou_inclusive"), match.iou(*boxes, CLIPPED).alias("iou_clipped"))


@query("match_boxes", MATCHED + f""" SELECT image_id, 'matched' AS status, det_id, box_id, iou FROM matched
UNION ALL SELECT image_id, 'unmatched_pred', det_id, NULL, NULL FROM pred_boxes p WHERE score >= {CONF} AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.image_id = p.image_id AND m.det_id = p.det_id)
UNION ALL SELECT image_id, 'unmatched_gt', NULL, box_id, NULL FROM gt_boxes g WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.image_id = g.image_id AND m.box_id = g.box_id)""")
def match_boxes(spark, sf_dir):
    gts, preds, matches = _matched(spark, sf_dir)
    return match.match_status(preds, gts, matches)


def _counts(spark, sf_dir):
    gts, preds, matches = _matched(spark, sf_dir)
    return metrics.image_counts(view(spark, sf_dir, "images").select("image_id", "sheet", "split"), gts, preds, matches), gts, matches


@query("match_counts", MATCHED + COUNTS + " SELECT image_id, tp, fp, fn, n_gt, n_pred FROM counts")
def match_counts(spark, sf_dir):
    return _counts(spark, sf_dir)[0].select("image_id", "tp", "fp", "fn", "n_gt", "n_pred")


@query("eval_metrics", MATCHED + COUNTS + f" SELECT {TOTALS} FROM counts")
def eval_metrics(spark, sf_dir):
    return metrics.totals(_counts(spark, sf_dir)[0])


@query("bin_metrics", MATCHED + COUNTS + binned_sql("counts") + " SELECT bin, tp, fp, fn, n_gt, recall FROM binned_recall")
def bin_metrics(spark, sf_dir):
    return metrics.bin_metrics(metrics.with_bins(_counts(spark, sf_dir)[0], view(spark, sf_dir, "analysis")))


def worst_sql(key: str = "") -> str:
    k = f"{key}, " if key else ""
    low = "n_gt > 0 AND recall < 1.0"
    rank = f"recall * 1000 + {ORDER_SQL.format('bin')} / 1e9"
    return f", worst AS (SELECT {k}coalesce(min(recall) FILTER ({low}), 1.0) AS worst_bin_recall, arg_min(bin, {rank}) FILTER ({low}) AS worst_bin FROM binned_recall GROUP BY {key or '()'})"


@query("worst_bin", MATCHED + COUNTS + binned_sql("counts") + worst_sql() + " SELECT * FROM worst")
def worst_bin(spark, sf_dir):
    return metrics.worst_bin(metrics.bin_metrics(metrics.with_bins(_counts(spark, sf_dir)[0], view(spark, sf_dir, "analysis"))))


SMALL = ", small AS (SELECT image_id, box_id FROM gt_boxes WHERE (x2 - x1) * (y2 - y1) <= (SELECT quantile_cont((x2 - x1) * (y2 - y1), 0.25) FROM gt_boxes))"


@query("small_recall", MATCHED + SMALL + ", t AS (SELECT (SELECT count(*) FROM matched SEMI JOIN small USING (image_id, box_id)) AS small_tp, (SELECT count(*) FROM small) AS small_gt) SELECT small_tp, small_gt, CAST(small_tp AS DOUBLE) / greatest(small_gt, 1) AS small_recall FROM t")
def small_recall(spark, sf_dir):
    gts, _, matches = _matched(spark, sf_dir)
    return metrics.small_recall(gts, matches)


def sweep_sql(name: str, values: list[float], scored: str, pairs: str) -> str:
    """``scored`` and ``pairs`` select from CTEs and have the threshold column ``name``."""
    rows = ", ".join(f"(CAST({v} AS DOUBLE))" for v in values)
    return f""", settings({name}) AS (VALUES {rows}), scored AS ({scored}), pairs AS ({pairs}), {walk_sql('pairs', name)},
counts AS (SELECT s.{name}, i.image_id, coalesce(g.n, 0) AS n_gt, coalesce(p.n, 0) AS n_pred, coalesce(m.n, 0) AS tp, coalesce(p.n, 0) - coalesce(m.n, 0) AS fp, coalesce(g.n, 0) - coalesce(m.n, 0) AS fn
FROM settings s CROSS JOIN images i LEFT JOIN (SELECT image_id, count(*) AS n FROM gt_boxes GROUP BY image_id) g ON g.image_id = i.image_id
LEFT JOIN (SELECT {name}, image_id, count(*) AS n FROM scored GROUP BY ALL) p ON p.image_id = i.image_id AND p.{name} = s.{name}
LEFT JOIN (SELECT {name}, image_id, count(*) AS n FROM matched GROUP BY ALL) m ON m.image_id = i.image_id AND m.{name} = s.{name}){binned_sql('counts', name)}{worst_sql(name)}{SMALL},
small_found AS (SELECT {name}, count(*) AS n FROM matched SEMI JOIN small USING (image_id, box_id) GROUP BY {name}),
total AS (SELECT {name}, {TOTALS} FROM counts GROUP BY {name})
SELECT total.*, worst_bin_recall, worst_bin, coalesce(f.n, 0) AS small_tp, z.n AS small_gt, CAST(coalesce(f.n, 0) AS DOUBLE) / greatest(z.n, 1) AS small_recall
FROM total JOIN worst USING ({name}) LEFT JOIN small_found f USING ({name}) CROSS JOIN (SELECT count(*) AS n FROM small) z"""


SWEEP_VIEWS = ctes("gt_boxes", "pred_boxes", "images", "analysis")


@query("sweep_conf", SWEEP_VIEWS + f", base AS ({pairs_sql(LEAST, min(CONFS))})" + sweep_sql("conf", CONFS, "SELECT s.conf, p.* FROM settings s JOIN pred_boxes p ON p.score >= s.conf", "SELECT s.conf, p.* FROM settings s JOIN base p ON p.score >= s.conf"))
def sweep_conf(spark, sf_dir):
    gts, preds = _base(spark, sf_dir)
    return metrics.conf_sweep(view(spark, sf_dir, "images"), gts, preds, view(spark, sf_dir, "analysis"), CONFS, LEAST)


NEAR_MATCHED = ctes("gt_boxes", "pred_boxes", "images") + f", pairs AS ({pairs_sql(NEAR, CONF)}), {walk_sql('pairs')}, kinds AS (SELECT g.image_id, g.box_id, CASE WHEN m.iou >= {LEAST} THEN 'hit' WHEN m.iou IS NOT NULL THEN 'near' ELSE 'miss' END AS kind FROM gt_boxes g LEFT JOIN matched m USING (image_id, box_id))"


def _kinds(spark, sf_dir):
    gts, _, matches = _matched(spark, sf_dir, NEAR)
    return metrics.near_miss_bins(gts, matches, LEAST)


@query("near_miss", NEAR_MATCHED + " SELECT kind, count(*) AS boxes, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM kinds) AS percent FROM kinds GROUP BY kind")
def near_miss(spark, sf_dir):
    kinds = _kinds(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("boxes"))
    total = kinds.agg(F.sum("boxes").alias("total"))
    return kinds.crossJoin(F.broadcast(total)).select("kind", "boxes", (F.lit(100.0) * F.col("boxes") / F.col("total")).alias("percent"))  # one row


BY_IMAGE = " SELECT image_id, count(*) FILTER (kind = 'hit') AS hits, count(*) FILTER (kind = 'near') AS near, count(*) FILTER (kind = 'miss') AS misses FROM kinds GROUP BY image_id"


@query("near_miss_by_image", NEAR_MATCHED + BY_IMAGE)
def near_miss_by_image(spark, sf_dir):
    return _kinds(spark, sf_dir).groupBy("image_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("hit", "hits"), ("near", "near"), ("miss", "misses"))))


@query("near_miss_top", NEAR_MATCHED + BY_IMAGE + " ORDER BY near DESC, image_id LIMIT 8")
def near_miss_top(spark, sf_dir):
    return near_miss_by_image(spark, sf_dir).orderBy(F.desc("near"), "image_id").limit(8)


@query("stress_eval", MATCHED + COUNTS + SMALL + f""", part AS (SELECT * FROM counts WHERE split = 'val'), found AS (SELECT count(*) AS n FROM matched SEMI JOIN small USING (image_id, box_id) SEMI JOIN part USING (image_id)), t AS (SELECT {TOTALS} FROM part)
SELECT t.*, found.n AS small_tp FROM t CROSS JOIN found""")
def stress_eval(spark, sf_dir):
    counts, gts, matches = _counts(spark, sf_dir)
    part = counts.where("split = 'val'")
    found = matches.join(metrics.small_truth(gts), ["image_id", "box_id"], "left_semi").join(part.select("image_id"), "image_id", "left_semi").agg(F.count(F.lit(1)).alias("small_tp"))
    return metrics.totals(part).crossJoin(F.broadcast(found))  # one row


@query("eval_by_model", ctes("gt_boxes", "pred_boxes", "images", "analysis") + f""", models AS (SELECT *, CASE WHEN det_id % 4 = 0 THEN 'main' ELSE 'extra' END AS model_id FROM pred_boxes WHERE score >= {CONF}),
pairs AS (SELECT p.model_id, p.image_id, p.det_id, g.box_id, {iou_sql('p', 'g')} AS iou FROM models p JOIN gt_boxes g ON p.image_id = g.image_id AND {TOUCH} WHERE {iou_sql('p', 'g')} >= {LEAST}), {walk_sql('pairs', 'model_id')},
counts AS (SELECT s.model_id, i.image_id, coalesce(g.n, 0) AS n_gt, coalesce(p.n, 0) AS n_pred, coalesce(m.n, 0) AS tp, coalesce(p.n, 0) - coalesce(m.n, 0) AS fp, coalesce(g.n, 0) - coalesce(m.n, 0) AS fn
FROM (VALUES ('main'), ('extra')) s(model_id) CROSS JOIN images i LEFT JOIN (SELECT image_id, count(*) AS n FROM gt_boxes GROUP BY image_id) g ON g.image_id = i.image_id
LEFT JOIN (SELECT model_id, image_id, count(*) AS n FROM models GROUP BY ALL) p ON p.image_id = i.image_id AND p.model_id = s.model_id
LEFT JOIN (SELECT model_id, image_id, count(*) AS n FROM matched GROUP BY ALL) m ON m.image_id = i.image_id AND m.model_id = s.model_id) SELECT model_id, {TOTALS} FROM counts GROUP BY model_id""")
def eval_by_model(spark, sf_dir):
    gts, preds = _base(spark, sf_dir)
    preds = preds.where(F.col("score") >= CONF).withColumn("model_id", F.when(F.col("det_id") % 4 == 0, "main").otherwise("extra"))
    pairs = match.candidate_pairs(preds, gts, LEAST, carry=["model_id"])
    keys = ["model_id", "image_id"]
    every = metrics.at_thresholds(view(spark, sf_dir, "images").select("image_id"), ["main", "extra"], "model_id")
    return metrics.totals(metrics.image_counts(every, gts, preds, match.greedy_matches(pairs, keys), keys), ["model_id"])


@query("eval_summary", MATCHED + COUNTS + f" SELECT 'images' AS gt_set, 0.4::DOUBLE AS iou_threshold, CAST(sum(n_gt) AS BIGINT) AS total_gt, CAST(sum(tp) AS BIGINT) AS matched_gt_0_4, CAST(sum(fp) AS BIGINT) AS total_fp, count(*) AS num_images FROM counts")
def eval_summary(spark, sf_dir):
    return _counts(spark, sf_dir)[0].agg(F.lit("images").alias("gt_set"), F.lit(LEAST).alias("iou_threshold"), F.sum("n_gt").alias("total_gt"), F.sum("tp").alias("matched_gt_0_4"), F.sum("fp").alias("total_fp"), F.count(F.lit(1)).alias("num_images"))
