"""Queries on label lines and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import labels
from gridloom.plans.fixtures import ctes, view
from gridloom.plans.registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_FIELDS = ", ".join(f"TRY_CAST(tok[{i + 2}] AS DOUBLE) AS {n}" for i, n in enumerate(labels.NAMES))
TOKENS = ctes("label_lines", "images") + rf""", toks AS (SELECT image_id, line_no, line, string_split_regex(trim(line), '\s+') AS tok FROM label_lines WHERE trim(line) <> ''),
parts AS (SELECT *, len(tok) AS n, CAST(round_even(TRY_CAST(tok[1] AS DOUBLE), 0) AS INTEGER) AS cls, {_FIELDS}, list_transform(tok[6:], lambda t: TRY_CAST(t AS DOUBLE)) AS rest FROM toks)"""
BOXED = "cx IS NOT NULL AND cy IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL"
PARSED = f"cls IS NOT NULL AND {BOXED}"
RANGES = [(f"NOT {n} BETWEEN 0 AND 1", f"{n}_out_of_range") for n in labels.NAMES] + [("w <= 0 OR h <= 0", "non_positive_size")]


def issues_sql(src: str, stop: str, checks: list[tuple[str, str]]) -> str:
    """A SELECT of (image_id, line_no, issue): the first stop of a line, or each check it fails."""
    out = f"SELECT image_id, line_no, {stop} AS issue FROM {src} WHERE {stop} IS NOT NULL"
    for condition, name in checks:
        text = f"'{name}'" if not name.startswith("CASE") else name
        out += f" UNION ALL SELECT image_id, line_no, {text} FROM {src} WHERE {stop} IS NULL AND ({condition})"
    return out


@query("parse_labels", TOKENS + f" SELECT image_id, line_no, cls, cx, cy, w, h, CASE WHEN n >= 11 AND n % 2 = 1 THEN CAST((n - 5) / 2 AS INTEGER) ELSE 0 END AS corners FROM parts WHERE n >= 5 AND {PARSED}")
def parse_labels(spark, sf_dir):
    out = labels.parse_labels(view(spark, sf_dir, "label_lines"))
    return out.select("image_id", "line_no", "cls", *labels.NAMES, F.coalesce(F.when(F.col("poly").isNotNull(), F.size("poly")), F.lit(0)).alias("corners"))


def _by_rule(cls: str, classes: str) -> str:
    return TOKENS + f" SELECT image_id, line_no, c AS cls, cx, cy, w, h FROM (SELECT *, {cls} AS c FROM parts) q WHERE n >= 5 AND c IN ({classes}) AND {BOXED}"


@query("parse_labels_whole", _by_rule("CASE WHEN regexp_full_match(tok[1], '[+-]?[0-9]+') THEN TRY_CAST(tok[1] AS INTEGER) END", "0"))
def parse_labels_whole(spark, sf_dir):
    return labels.parse_labels(view(spark, sf_dir, "label_lines"), [0], rule="whole").drop("poly")


@query("parse_labels_truncated", _by_rule("CAST(trunc(TRY_CAST(tok[1] AS DOUBLE)) AS INTEGER)", "0, 1"))
def parse_labels_truncated(spark, sf_dir):
    return labels.parse_labels(view(spark, sf_dir, "label_lines"), [0, 1], rule="truncated").drop("poly")


DETECTION_STOP = f"(CASE WHEN cls IS NULL THEN 'class_unreadable' WHEN n <> 5 THEN 'token_count' WHEN NOT ({BOXED}) THEN 'box_unreadable' END)"


@query("validate_detection", TOKENS + " " + issues_sql("parts", DETECTION_STOP, [*RANGES, ("cls NOT IN (0, 1)", "class_not_allowed")]))
def validate_detection(spark, sf_dir):
    return labels.validate_detection(view(spark, sf_dir, "label_lines"))


SEGMENT_STOP = f"(CASE WHEN cls IS NULL THEN 'class_unreadable' WHEN n < 5 THEN 'token_count' WHEN NOT ({BOXED}) THEN 'box_unreadable' END)"
POLY = "CASE WHEN cls <> 0 THEN CASE WHEN n <> 5 THEN 'tag_with_polygon' END WHEN n - 5 < 6 THEN 'polygon_short' WHEN (n - 5) % 2 <> 0 THEN 'polygon_odd' WHEN len(list_filter(rest, lambda v: v IS NULL)) > 0 THEN 'polygon_unreadable' WHEN len(list_filter(rest, lambda v: NOT v BETWEEN 0 AND 1)) > 0 THEN 'polygon_out_of_range' END"


@query("validate_segmentation", TOKENS + " " + issues_sql("parts", SEGMENT_STOP, [*RANGES, (f"({POLY}) IS NOT NULL", POLY)]))
def validate_segmentation(spark, sf_dir):
    return labels.validate_segmentation(view(spark, sf_dir, "label_lines"))


@query("detect_format", TOKENS + " SELECT image_id, CASE WHEN max(n) > 5 THEN 'segmentation' ELSE 'detection' END AS format FROM parts GROUP BY image_id")
def detect_format(spark, sf_dir):
    return labels.detect_format(view(spark, sf_dir, "label_lines"))


def _files(spark, sf_dir):
    """Label files: of most images, some of them empty; and images: some have no file, some files no image."""
    every = view(spark, sf_dir, "images").select("image_id")
    return every.where("image_id % 11 <> 0"), every.where("image_id % 13 <> 0")


FILES = ", files AS (SELECT image_id FROM images WHERE image_id % 11 <> 0), shown AS (SELECT image_id FROM images WHERE image_id % 13 <> 0)"
AUDIT_POLY = POLY.replace("CASE WHEN cls <> 0 THEN CASE WHEN n <> 5 THEN 'tag_with_polygon' END WHEN n - 5 < 6 THEN 'polygon_short' WHEN", "CASE WHEN n <= 5 THEN NULL WHEN")


def audit_ctes(files: str) -> str:
    stop = f"(CASE WHEN format = 'detection' AND n <> 5 THEN 'tokens_not_5' WHEN format <> 'detection' AND n < 5 THEN 'too_few_tokens' WHEN NOT ({PARSED}) THEN 'parse_error' END)"
    return f""", formats AS (SELECT image_id, CASE WHEN max(n) > 5 THEN 'segmentation' ELSE 'detection' END AS format FROM parts GROUP BY image_id),
checked AS (SELECT p.* EXCLUDE (line_no), CAST(row_number() OVER (PARTITION BY image_id ORDER BY line_no) AS INTEGER) AS line_no, format FROM parts p JOIN formats USING (image_id) WHERE image_id IN (SELECT image_id FROM {files})),
issues AS ({issues_sql('checked', stop, [('cls NOT IN (0, 1)', 'class_not_allowed'), *RANGES, (f'({AUDIT_POLY}) IS NOT NULL', AUDIT_POLY)])} UNION ALL SELECT image_id, 0, 'empty_file' FROM {files} WHERE image_id NOT IN (SELECT image_id FROM parts))"""


@query("audit_issues", TOKENS + FILES + audit_ctes("files") + " SELECT * FROM issues")
def audit_issues(spark, sf_dir):
    return labels.audit(view(spark, sf_dir, "label_lines"), _files(spark, sf_dir)[0])


@query("audit_sample", TOKENS + FILES + audit_ctes("files") + " SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY line_no, issue) AS INTEGER) AS nth FROM issues WHERE image_id IN (SELECT DISTINCT image_id FROM issues ORDER BY image_id LIMIT 30)) WHERE nth <= 5")
def audit_sample(spark, sf_dir):
    return labels.audit_sample(audit_issues(spark, sf_dir), 5, 30)


@query("class_hist", TOKENS + FILES + audit_ctes("files") + f" SELECT cls, count(*) AS lines FROM checked WHERE (CASE WHEN format = 'detection' THEN n = 5 ELSE n >= 5 END) AND {PARSED} GROUP BY cls")
def class_hist(spark, sf_dir):
    return labels.class_hist(view(spark, sf_dir, "label_lines"), _files(spark, sf_dir)[0])


PAIRING = FILES + ", pairing AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, CASE WHEN b.image_id IS NULL THEN 'missing_label' WHEN a.image_id IS NULL THEN 'orphan_label' ELSE 'paired' END AS status FROM shown a FULL OUTER JOIN files b ON a.image_id = b.image_id)"


@query("pairing_audit", ctes("images") + PAIRING + " SELECT * FROM pairing")
def pairing_audit(spark, sf_dir):
    files, shown = _files(spark, sf_dir)
    return labels.pairing(shown, files)


@query("audit_stats", TOKENS + PAIRING + ", paired AS (SELECT image_id FROM pairing WHERE status = 'paired')" + audit_ctes("paired") + """, t AS (SELECT count(*) FILTER (status <> 'orphan_label') AS images, count(*) FILTER (status = 'paired') AS paired, count(*) FILTER (status = 'missing_label') AS missing_label, count(*) FILTER (status = 'orphan_label') AS orphan_label FROM pairing)
SELECT t.*, (SELECT count(DISTINCT image_id) FROM issues) AS files_with_issues, (SELECT count(*) FROM issues) AS issues, (SELECT count(*) FROM checked) AS lines, CAST((SELECT count(*) FROM checked) AS DOUBLE) / t.paired AS lines_per_image FROM t""")
def audit_stats(spark, sf_dir):
    files, shown = _files(spark, sf_dir)
    return labels.audit_stats(shown, files, view(spark, sf_dir, "label_lines"))


SIDE = 3072
NORMAL = f"CAST(x1 + x2 AS DOUBLE) / 2 / {SIDE} AS cx, CAST(y1 + y2 AS DOUBLE) / 2 / {SIDE} AS cy, CAST(x2 - x1 AS DOUBLE) / {SIDE} AS w, CAST(y2 - y1 AS DOUBLE) / {SIDE} AS h"
TEXT = "printf('%d %.6f %.6f %.6f %.6f', cls, cx, cy, w, h)"


def _texts(spark, sf_dir, boxes=None):
    b = view(spark, sf_dir, "gt_boxes") if boxes is None else boxes
    n = b.select("image_id", "box_id", "cls", ((F.col("x1") + F.col("x2")) / 2 / SIDE).alias("cx"), ((F.col("y1") + F.col("y2")) / 2 / SIDE).alias("cy"), ((F.col("x2") - F.col("x1")) / SIDE).alias("w"), ((F.col("y2") - F.col("y1")) / SIDE).alias("h"))
    return n.select("image_id", "box_id", labels.label_line("cls", *labels.NAMES).alias("text"))


@query("label_text", ctes("images", "gt_boxes") + f", n AS (SELECT image_id, box_id, cls, {NORMAL} FROM gt_boxes), t AS (SELECT image_id, string_agg({TEXT}, chr(10) ORDER BY box_id) AS text FROM n GROUP BY image_id) SELECT image_id, coalesce(t.text, '') AS text FROM images LEFT JOIN t USING (image_id)")
def label_text(spark, sf_dir):
    return labels.label_text(_texts(spark, sf_dir), view(spark, sf_dir, "images"), "box_id")


@query("panel_only_labels", ctes("images", "gt_boxes") + f", n AS (SELECT image_id, box_id, CASE WHEN pk % 5 = 0 THEN 1 ELSE 0 END AS cls, {NORMAL} FROM gt_boxes), t AS (SELECT image_id, string_agg({TEXT}, chr(10) ORDER BY box_id) AS text FROM n WHERE cls = 0 GROUP BY image_id) SELECT image_id, coalesce(t.text, '') AS text FROM images LEFT JOIN t USING (image_id)")
def panel_only_labels(spark, sf_dir):
    b = view(spark, sf_dir, "gt_boxes").withColumn("cls", F.when(F.col("pk") % 5 == 0, 1).otherwise(0))
    return labels.label_text(_texts(spark, sf_dir, b.where("cls = 0")), view(spark, sf_dir, "images"), "box_id")


@query("box_orientation", ctes("gt_boxes") + " SELECT image_id, box_id, CASE WHEN x2 - x1 > y2 - y1 THEN 'horizontal' ELSE 'vertical' END AS orientation, CASE WHEN x2 - x1 > y2 - y1 THEN CAST(x2 - x1 AS DOUBLE) / (y2 - y1) ELSE CAST(y2 - y1 AS DOUBLE) / (x2 - x1) END AS ratio FROM gt_boxes")
def box_orientation(spark, sf_dir):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return view(spark, sf_dir, "gt_boxes").select("image_id", "box_id", F.when(w > h, "horizontal").otherwise("vertical").alias("orientation"), F.when(w > h, w / h).otherwise(h / w).alias("ratio"))


@query("relabel_from_source", ctes("images", "gt_boxes") + """, s AS (SELECT image_id, box_id, 'train' AS source, 0 AS prio FROM gt_boxes WHERE image_id % 3 = 0 UNION ALL SELECT image_id, box_id, 'val', 1 FROM gt_boxes WHERE image_id % 2 = 0),
f AS (SELECT * FROM s QUALIFY prio = min(prio) OVER (PARTITION BY image_id)) SELECT image_id, source, box_id FROM images LEFT JOIN f USING (image_id)""")
def relabel_from_source(spark, sf_dir):
    b = view(spark, sf_dir, "gt_boxes")
    return labels.relabel(view(spark, sf_dir, "images"), [("train", b.where("image_id % 3 = 0")), ("val", b.where("image_id % 2 = 0"))])
