"""Views of boxes, images, labels and pixels, derived from the test tables by integer arithmetic (see FIXTURES.md).

Each text runs unchanged in Spark SQL and in DuckDB; ``view`` gives the DataFrame and ``ctes`` the WITH clause of an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "orders", "lineitem")

VIEWS = {
    "gt_boxes": """
WITH b AS (SELECT l_orderkey AS ok, l_linenumber AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber),
k AS (SELECT CAST(floor(ok / 4) AS BIGINT) AS image_id, CAST((ok % 4) * 8 + ln AS BIGINT) AS box_id, pk, sk FROM b)
SELECT image_id, box_id, pk, sk, 0 AS cls,
  CAST((box_id % 6) * 330 + pk % 97 AS BIGINT) AS x1,
  CAST(floor(box_id / 6) AS BIGINT) * 330 + sk % 89 AS y1,
  CAST((box_id % 6) * 330 + pk % 97 + 200 + (pk * 31) % 300 AS BIGINT) AS x2,
  CAST(floor(box_id / 6) AS BIGINT) * 330 + sk % 89 + 200 + (sk * 17) % 300 AS y2
FROM k WHERE pk % 16 < image_id % 17""",
    "pred_boxes": """
SELECT image_id, box_id * 4 AS det_id, x1 + dx AS x1, y1 + dy AS y1, x2 + dx AS x2, y2 + dy AS y2,
  CAST((pk * 13 + sk * 7) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score
FROM (SELECT g.*, CASE WHEN pk % 13 = 0 THEN CAST(floor((x2 - x1) / 2) AS BIGINT) ELSE (pk * 7) % 31 - 15 END AS dx, (sk * 5) % 31 - 15 AS dy FROM gt_boxes g) m
WHERE pk % 23 <> 0
UNION ALL
SELECT image_id, box_id * 4 + 1, x1 + 4, y1 + 3, x2 + 4, y2 + 3,
  CAST((pk * 11 + sk * 3) % 700 AS DOUBLE) / CAST(1000 AS DOUBLE)
FROM gt_boxes WHERE pk % 3 = 0
UNION ALL
SELECT image_id, box_id * 4 + 2, x1 + 160, y1 + 40, x2 + 160, y2 + 40,
  CAST((pk * 17 + sk) % 500 AS DOUBLE) / CAST(1000 AS DOUBLE)
FROM gt_boxes WHERE pk % 19 = 0""",
    "images": """
SELECT DISTINCT CAST(floor(o_orderkey / 4) AS BIGINT) AS image_id,
  concat('x', CAST(CAST(floor(o_orderkey / 4) AS BIGINT) % 1009 AS STRING)) AS sheet,
  CASE WHEN CAST(floor(o_orderkey / 4) AS BIGINT) % 1009 % 5 = 0 THEN 'val' ELSE 'train' END AS split,
  900 + (CAST(floor(o_orderkey / 4) AS BIGINT) * 37) % 3300 AS width,
  900 + (CAST(floor(o_orderkey / 4) AS BIGINT) * 53) % 3300 AS height
FROM orders""",
    "analysis": """
SELECT i.image_id, concat(i.sheet, '_s1_r', CAST(i.image_id AS STRING), '_c0.jpg') AS filename,
  CASE WHEN i.image_id % 29 = 0 THEN NULL ELSE coalesce(g.n, 0) END AS num_panels
FROM images i LEFT JOIN (SELECT image_id, count(*) AS n FROM gt_boxes GROUP BY image_id) g ON i.image_id = g.image_id
WHERE i.image_id % 31 <> 0""",
    "label_lines": """
SELECT image_id, box_id AS line_no,
  CASE WHEN pk % 37 = 0 THEN concat('0 0.', lpad(CAST(cx AS STRING), 6, '0'), ' 0.5 0.1')
       WHEN pk % 41 = 0 THEN concat('x 0.', lpad(CAST(cx AS STRING), 6, '0'), ' 0.5 0.1 0.1')
       WHEN pk % 43 = 0 THEN '0 1.200000 0.5 0.1 0.1'
       WHEN pk % 47 = 0 THEN '0 0.5 0.5 0 0.1'
       WHEN pk % 53 = 0 THEN '0 0.5 0.5 0.1 0.1 0.4 0.4'
       WHEN pk % 59 = 0 THEN '5 0.5 0.5 0.1 0.1'
       WHEN pk % 61 = 0 THEN '0.7 0.5 0.5 0.1 0.1'
       WHEN pk % 67 = 0 THEN '1.0 0.25 0.5 0.1 0.1'
       ELSE concat(CASE WHEN pk % 7 = 0 THEN '1' ELSE '0' END, ' 0.', lpad(CAST(cx AS STRING), 6, '0'), ' 0.', lpad(CAST(cy AS STRING), 6, '0'),
                   ' 0.', lpad(CAST(w AS STRING), 6, '0'), ' 0.', lpad(CAST(h AS STRING), 6, '0')) END AS line
FROM (SELECT image_id, box_id, pk, CAST(floor((x1 + x2) * 500000 / 3072) AS BIGINT) AS cx, CAST(floor((y1 + y2) * 500000 / 3072) AS BIGINT) AS cy,
  CAST(floor((x2 - x1) * 1000000 / 3072) AS BIGINT) AS w, CAST(floor((y2 - y1) * 1000000 / 3072) AS BIGINT) AS h FROM gt_boxes) q""",
    "tile_dets": """
SELECT p.image_id, t.tx, t.ty, p.det_id, p.x1 - t.tx AS lx1, p.y1 - t.ty AS ly1, p.x2 - t.tx AS lx2, p.y2 - t.ty AS ly2, p.score
FROM pred_boxes p CROSS JOIN (SELECT a.v AS tx, b.v AS ty FROM (SELECT 0 AS v UNION ALL SELECT 1075) a CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1075) b) t
WHERE p.x1 >= t.tx AND p.y1 >= t.ty AND p.x2 <= t.tx + 1536 AND p.y2 <= t.ty + 1536""",
    "rois": """
SELECT image_id, CASE WHEN image_id % 9 = 0 OR image_id % 14 = 3 THEN NULL ELSE a END AS x0, CASE WHEN image_id % 9 = 0 OR image_id % 15 = 4 THEN NULL ELSE b END AS y0,
  CASE WHEN image_id % 9 = 0 OR image_id % 16 = 5 THEN NULL WHEN image_id % 13 = 5 THEN a WHEN image_id % 17 = 7 THEN a - 10 ELSE a + 1200 END AS x1,
  CASE WHEN image_id % 9 = 0 THEN NULL WHEN image_id % 19 = 6 THEN b ELSE b + 1200 END AS y1
FROM (SELECT image_id, (image_id * 13) % 400 AS a, (image_id * 7) % 400 AS b FROM images) q""",
    "pixels": """
SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS image_id, (l_partkey * 7 + l_suppkey) % 512 AS x, (l_partkey * 3 + l_suppkey * 11) % 512 AS y,
  (l_partkey * 5) % 256 AS r, CASE WHEN l_partkey % 4 = 0 THEN (l_suppkey * 9) % 256 ELSE (l_partkey * 5) % 256 END AS g,
  CASE WHEN l_partkey % 4 = 0 THEN (l_suppkey * 29) % 256 ELSE (l_partkey * 5) % 256 END AS b
FROM lineitem""",
    "runs": """
SELECT CAST(o_orderkey AS BIGINT) AS exp_num, 'A' AS phase,
  CAST((o_orderkey * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS worst_bin_recall, CAST((o_orderkey * 53) % 90 AS DOUBLE) / CAST(100 AS DOUBLE) AS fp_per_image
FROM orders""",
    "paths": """
SELECT concat('/data/', CASE image_id % 7 WHEN 1 THEN 'pred' WHEN 2 THEN 'run_12' WHEN 3 THEN 'pred_old' WHEN 4 THEN 'pdf_pages' WHEN 5 THEN 'predicted' ELSE sheet END, '/', CAST(image_id AS STRING), '.v1',
  CASE image_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.txt' WHEN 3 THEN '.tiff' ELSE '' END) AS path, width AS length
FROM images""",
}


def _used(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables in ``sf_dir``."""
    sql = VIEWS[name]
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _used(sql, TABLES)} | {n: view(spark, sf_dir, n) for n in _used(sql, VIEWS)}
    for n in frames:
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **frames)


def ctes(*names: str) -> str:
    """``WITH`` and the named views with all that they read, for DuckDB; more CTEs may follow after a comma."""
    order: list[str] = []

    def add(name):
        for n in _used(VIEWS[name], VIEWS):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
