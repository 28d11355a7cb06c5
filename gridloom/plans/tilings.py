"""Queries on column functions, tiles, crops and regions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import boxes as fb
from gridloom.operators import tiling
from gridloom.operators.cells import meet
from gridloom.operators.polygons import signed_area
from gridloom.plans.fixtures import ctes, view
from gridloom.plans.registry import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

TILE, SHARE, SIDE = 1536, 0.3, 3072
STRIDE = tiling.stride_of(TILE, SHARE)


def _d(x):
    return f"CAST({x} AS DOUBLE)"


def _unit(x):
    return f"least(greatest({x}, 0.0), 1.0)"


@query("box_convert", ctes("gt_boxes") + f""", n AS (SELECT image_id, box_id, {_d('x1 + x2')} / 2 / {SIDE} AS cx, {_d('y1 + y2')} / 2 / {SIDE} AS cy, {_d('x2 - x1')} / {SIDE} AS w, {_d('y2 - y1')} / {SIDE} AS h FROM gt_boxes)
SELECT image_id, box_id, cx - w / 2 AS nx1, cy - h / 2 AS ny1, cx + w / 2 AS nx2, cy + h / 2 AS ny2, cx AS raw_cx, {_unit('cx')} AS cx, {_unit('cy')} AS cy, {_unit('w')} AS w, {_unit('h')} AS h FROM n""")
def box_convert(spark, sf_dir):
    b = view(spark, sf_dir, "gt_boxes")
    raw, held = (fb.centre_form(tiling.CORNERS, F.lit(SIDE), F.lit(SIDE), clamp) for clamp in (False, True))
    n = b.select("image_id", "box_id", *(v.alias(f"r{c}") for v, c in zip(raw, ("cx", "cy", "w", "h"), strict=True)), *(v.alias(c) for v, c in zip(held, ("cx", "cy", "w", "h"), strict=True)))
    back = fb.corners("rcx", "rcy", "rw", "rh")
    return n.select("image_id", "box_id", *(v.alias(f"n{c}") for v, c in zip(back, tiling.CORNERS, strict=True)), F.col("rcx").alias("raw_cx"), "cx", "cy", "w", "h")


@query("box_to_pixels", ctes("gt_boxes") + f""", n AS (SELECT image_id, box_id, {_d('x1 + x2')} / 2 / {SIDE} AS cx, {_d('x2 - x1')} / {SIDE} AS w FROM gt_boxes)
SELECT image_id, box_id, CAST(round_even((cx - w / 2) * 1000, 0) AS BIGINT) AS rounded, CAST(trunc((cx - w / 2) * 1000) AS BIGINT) AS truncated, CAST(trunc(cx * 1000) AS BIGINT) - CAST(floor(trunc(w * 1000) / 2) AS BIGINT) AS halved FROM n""")
def box_to_pixels(spark, sf_dir):
    b = view(spark, sf_dir, "gt_boxes").select("image_id", "box_id", ((F.col("x1") + F.col("x2")) / 2 / SIDE).alias("cx"), ((F.col("x2") - F.col("x1")) / SIDE).alias("w"))
    left = (F.col("cx") - F.col("w") / 2) * 1000
    return b.select("image_id", "box_id", F.bround(left).cast("long").alias("rounded"), left.cast("long").alias("truncated"), ((F.col("cx") * 1000).cast("long") - F.floor((F.col("w") * 1000).cast("long") / 2)).alias("halved"))


@query("poly_bbox", ctes("gt_boxes") + " SELECT image_id, box_id, least(x1, x2, x1 + 50) AS px1, least(y1 - 20, y1, y2) AS py1, greatest(x1 + 50, x2, x1) AS px2, greatest(y1 - 20, y2, y1) AS py2 FROM gt_boxes")
def poly_bbox(spark, sf_dir):
    """Polygons of five corners: a box with one more corner above its top side."""
    b = view(spark, sf_dir, "gt_boxes")
    extra = F.array(F.struct((F.col("x1") + 50).alias("x"), (F.col("y1") - 20).alias("y")))
    box = fb.poly_bbox(F.concat(fb.bbox_poly(tiling.CORNERS), extra))
    return b.select("image_id", "box_id", *(v.alias(f"p{c}") for v, c in zip(box, tiling.CORNERS, strict=True)))


@query("density_bin", ctes("images", "gt_boxes") + f", n AS (SELECT i.image_id, count(g.box_id) AS n FROM images i LEFT JOIN gt_boxes g USING (image_id) GROUP BY i.image_id) SELECT image_id, n, {fb.DENSITY_SQL.format('n')} AS bin, {fb.ORDER_SQL.format('(' + fb.DENSITY_SQL.format('n') + ')')} AS bin_order FROM n")
def density_bin(spark, sf_dir):
    n = view(spark, sf_dir, "images").select("image_id").join(view(spark, sf_dir, "gt_boxes").groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "image_id", "left").fillna(0, ["n"])
    return n.withColumn("bin", fb.density_bin("n")).withColumn("bin_order", fb.density_order("bin"))


def _starts(side, tile=TILE, stride=STRIDE):
    return f"unnest(generate_series(0, greatest({side} - {tile}, 0), {stride}))"


GRID = f"grid AS (SELECT image_id, tx, ty, least(tx + {TILE}, width) AS tx2, least(ty + {TILE}, height) AS ty2 FROM (SELECT image_id, width, height, tx, {_starts('height')} AS ty FROM (SELECT image_id, width, height, {_starts('width')} AS tx FROM images)))"


@query("tile_grid", ctes("images") + f", {GRID} SELECT * FROM grid")
def tile_grid(spark, sf_dir):
    return tiling.tile_grid(view(spark, sf_dir, "images"), TILE, SHARE)


def _preview(side, axis):
    n = f"greatest(0, CAST(ceil(CAST({side} - {TILE} AS DOUBLE) / {STRIDE}) AS BIGINT))"
    return f"unnest(list_transform(generate_series(0, {n}), lambda k: k * {STRIDE} - CAST(floor(({n} * {STRIDE} + {TILE} - greatest({side}, {TILE})) / 2) AS BIGINT))) AS {axis}"


@query("tile_grid_preview", ctes("images") + f" SELECT image_id, tx, {_preview('height', 'ty')} FROM (SELECT image_id, height, {_preview('width', 'tx')} FROM images)")
def tile_grid_preview(spark, sf_dir):
    return tiling.preview_grid(view(spark, sf_dir, "images"), TILE, SHARE, centred=True)


MINE, STEP = 640, 512


@query("empty_tiles", ctes("images", "gt_boxes") + f""", tiles AS (SELECT image_id, tx, unnest(generate_series(0, height - {MINE}, {STEP})) AS ty FROM (SELECT image_id, height, unnest(generate_series(0, width - {MINE}, {STEP})) AS tx FROM images WHERE width >= {MINE} AND height >= {MINE}))
SELECT image_id, tx, ty FROM tiles t WHERE NOT EXISTS (SELECT 1 FROM gt_boxes b WHERE b.image_id = t.image_id AND b.x1 <= t.tx + {MINE} AND b.x2 >= t.tx AND b.y1 <= t.ty + {MINE} AND b.y2 >= t.ty)""")
def empty_tiles(spark, sf_dir):
    return tiling.empty_tiles(tiling.mining_grid(view(spark, sf_dir, "images"), MINE), view(spark, sf_dir, "gt_boxes"), MINE)


def labels_ctes(tiles: str, out: str) -> str:
    return f"""{out}_c AS (SELECT t.image_id, tx, ty, box_id, cls, greatest(x1, tx) AS x1, greatest(y1, ty) AS y1, least(x2, tx + {TILE}) AS x2, least(y2, ty + {TILE}) AS y2
FROM (SELECT DISTINCT image_id, tx, ty FROM {tiles}) t JOIN gt_boxes b ON t.image_id = b.image_id AND x1 < tx + {TILE} AND x2 > tx AND y1 < ty + {TILE} AND y2 > ty),
{out}_l AS (SELECT image_id, tx, ty, box_id, cls, ({_d('x1 + x2')} / 2 - tx) / {TILE} AS cx, ({_d('y1 + y2')} / 2 - ty) / {TILE} AS cy, {_d('x2 - x1')} / {TILE} AS w, {_d('y2 - y1')} / {TILE} AS h FROM {out}_c),
{out} AS (SELECT * FROM {out}_l WHERE w * h >= 0.0015)"""


@query("tile_labels", ctes("images", "gt_boxes") + f", {GRID}, {labels_ctes('grid', 'labels')} SELECT * FROM labels")
def tile_labels(spark, sf_dir):
    return tiling.tile_labels(tile_grid(spark, sf_dir), view(spark, sf_dir, "gt_boxes"), TILE)


LEAST = 0.06


def _new(axis, side, centre):
    return f"CAST(trunc(greatest(0.0, least({side} - {TILE}.0::DOUBLE, {axis} + {centre} * {TILE} - {TILE} / 2.0::DOUBLE))) AS BIGINT)"


@query("retile", ctes("images", "gt_boxes") + f""", {GRID}, {labels_ctes('grid', 'labels')},
best AS (SELECT image_id, tx, ty, w * h AS area, cx, cy FROM labels QUALIFY row_number() OVER (PARTITION BY image_id, tx, ty ORDER BY w * h DESC, box_id) = 1),
small AS (SELECT image_id, tx, ty, area, {_new('tx', 'width', 'cx')} AS new_tx, {_new('ty', 'height', 'cy')} AS new_ty FROM best JOIN images USING (image_id) WHERE area < {LEAST}),
{labels_ctes('(SELECT image_id, new_tx AS tx, new_ty AS ty FROM small)', 'tried')},
found AS (SELECT image_id, tx AS new_tx, ty AS new_ty, max(w * h) AS new_area FROM tried GROUP BY ALL),
adopted AS (SELECT image_id, tx, ty, new_tx, new_ty FROM small JOIN found USING (image_id, new_tx, new_ty) WHERE new_area >= greatest(area, {LEAST})),
placed AS (SELECT b.image_id, b.tx, b.ty, coalesce(new_tx, b.tx) AS new_tx, coalesce(new_ty, b.ty) AS new_ty, new_tx IS NOT NULL AS moved FROM best b LEFT JOIN adopted a ON a.image_id = b.image_id AND a.tx = b.tx AND a.ty = b.ty)
SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY image_id, new_tx, new_ty ORDER BY moved DESC, ty, tx) = 1""")
def retile(spark, sf_dir):
    images = view(spark, sf_dir, "images")
    return tiling.retile(tile_grid(spark, sf_dir), view(spark, sf_dir, "gt_boxes"), images, TILE, LEAST)


def _classed(spark, sf_dir):
    """A quarter of the boxes, made small, as tags; the others as panels."""
    b = view(spark, sf_dir, "gt_boxes")
    tags = b.where("pk % 4 = 0").select("image_id", "box_id", F.lit(1).alias("cls"), "x1", "y1", (F.col("x1") + 40).alias("x2"), (F.col("y1") + 30).alias("y2"))
    return b.where("pk % 4 <> 0").select("image_id", "box_id", "cls", *tiling.CORNERS), tags


CROPS = """, panels AS (SELECT image_id, box_id, cls, x1, y1, x2, y2 FROM gt_boxes WHERE pk % 4 <> 0), tags AS (SELECT image_id, box_id, 1 AS cls, x1, y1, x1 + 40 AS x2, y1 + 30 AS y2 FROM gt_boxes WHERE pk % 4 = 0),
held AS (SELECT p.image_id, p.box_id, min(t.x1) AS tx1, min(t.y1) AS ty1, max(t.x2) AS tx2, max(t.y2) AS ty2, count(*) AS tags FROM panels p JOIN tags t ON p.image_id = t.image_id AND (t.x1 + t.x2) / 2.0::DOUBLE > p.x1 AND (t.x1 + t.x2) / 2.0::DOUBLE < p.x2 AND (t.y1 + t.y2) / 2.0::DOUBLE > p.y1 AND (t.y1 + t.y2) / 2.0::DOUBLE < p.y2 GROUP BY ALL),
crops AS (SELECT * FROM (SELECT p.image_id, p.box_id AS panel_id, coalesce(h.tags, 0) AS tags, greatest(0, CAST(trunc(least(p.x1 - (p.x2 - p.x1) * 0.22::DOUBLE, tx1)) AS BIGINT)) AS cx1, greatest(0, CAST(trunc(least(p.y1 - (p.y2 - p.y1) * 0.22::DOUBLE, ty1)) AS BIGINT)) AS cy1,
least(width, CAST(trunc(greatest(p.x2 + (p.x2 - p.x1) * 0.22::DOUBLE, tx2)) AS BIGINT)) AS cx2, least(height, CAST(trunc(greatest(p.y2 + (p.y2 - p.y1) * 0.22::DOUBLE, ty2)) AS BIGINT)) AS cy2 FROM panels p LEFT JOIN held h USING (image_id, box_id) JOIN images USING (image_id) WHERE p.x2 - p.x1 >= 1 AND p.y2 - p.y1 >= 1) WHERE cx2 > cx1 AND cy2 > cy1)"""


@query("crop_windows", ctes("images", "gt_boxes") + CROPS + " SELECT * FROM crops")
def crop_windows(spark, sf_dir):
    return tiling.crop_windows(*_classed(spark, sf_dir), view(spark, sf_dir, "images"))


#: Panels as diamonds within their boxes: four corners, each the middle of a side.
_DIAMOND = [("mx", "y1"), ("x2", "my"), ("mx", "y2"), ("x1", "my")]


def _crossings(x, y):
    """How often a ray to the right of (x, y) crosses the sides of panel p."""
    at = {"x1": "p.x1", "x2": "p.x2", "y1": "p.y1", "y2": "p.y2", "mx": "((p.x1 + p.x2) / 2.0::DOUBLE)", "my": "((p.y1 + p.y2) / 2.0::DOUBLE)"}
    sides = [(at[a], at[b], at[c], at[d]) for (a, b), (c, d) in zip(_DIAMOND, _DIAMOND[1:] + _DIAMOND[:1], strict=True)]
    return " + ".join(f"CASE WHEN ({b} > {y}) <> ({d} > {y}) AND {x} < {a} + ({c} - {a}) * (({y} - {b}) / CAST({d} - {b} AS DOUBLE)) THEN 1 ELSE 0 END" for a, b, c, d in sides)


_INSIDE_DIAMOND = f" AND ({_crossings('(t.x1 + t.x2) / 2.0::DOUBLE', '(t.y1 + t.y2) / 2.0::DOUBLE')}) % 2 = 1 GROUP BY ALL),"


@query("crop_windows_poly", ctes("images", "gt_boxes") + CROPS.replace(" GROUP BY ALL),", _INSIDE_DIAMOND, 1) + " SELECT * FROM crops")
def crop_windows_poly(spark, sf_dir):
    panels, tags = _classed(spark, sf_dir)
    at = {c: F.col(c).cast("double") for c in tiling.CORNERS} | {"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2}
    panels = panels.withColumn("poly", F.array(*(F.struct(at[x].alias("x"), at[y].alias("y")) for x, y in _DIAMOND)))
    return tiling.crop_windows(panels, tags, view(spark, sf_dir, "images"))


BOXED = 640


@query("crop_letterbox_labels", ctes("images", "gt_boxes") + CROPS + f""", cut AS (SELECT c.image_id, panel_id, box_id, cls, cx1, cy1, cx2 - cx1 AS cw, cy2 - cy1 AS ch, greatest(x1, cx1) AS x1, greatest(y1, cy1) AS y1, least(x2, cx2) AS x2, least(y2, cy2) AS y2 FROM crops c JOIN (SELECT * FROM panels UNION ALL SELECT * FROM tags) b ON c.image_id = b.image_id AND x1 < cx2 AND x2 > cx1 AND y1 < cy2 AND y2 > cy1),
s AS (SELECT *, {BOXED}.0::DOUBLE / greatest(cw, ch) AS scale FROM cut WHERE (x2 - x1) * (y2 - y1) >= 1), o AS (SELECT *, floor(({BOXED} - trunc(cw * scale)) / 2) AS lft, floor(({BOXED} - trunc(ch * scale)) / 2) AS top FROM s),
l AS (SELECT image_id, panel_id, box_id, cls, (({_d('x1 + x2')} / 2 - cx1) * scale + lft) / {BOXED} AS cx, (({_d('y1 + y2')} / 2 - cy1) * scale + top) / {BOXED} AS cy, (x2 - x1) * scale / {BOXED} AS w, (y2 - y1) * scale / {BOXED} AS h FROM o) SELECT * FROM l WHERE w >= 1e-4 AND h >= 1e-4""")
def crop_letterbox_labels(spark, sf_dir):
    panels, tags = _classed(spark, sf_dir)
    return tiling.letterbox(crop_windows(spark, sf_dir), panels.unionByName(tags), BOXED)


def _held(c, side, missing):
    return f"greatest(0, least(coalesce(r.{c}, {missing}), {side} - 1)) AS {c}"


MANIFEST = f", manifest AS (SELECT * FROM (SELECT image_id, {_held('x0', 'width', 0)}, {_held('y0', 'height', 0)}, {_held('x1', 'width', 'width - 1')}, {_held('y1', 'height', 'height - 1')}, r.x0 IS NULL AND r.y0 IS NULL AND r.x1 IS NULL AND r.y1 IS NULL AS whole FROM rois r JOIN images USING (image_id)) WHERE x1 >= x0 AND y1 >= y0)"


@query("manifest_boxes", ctes("rois", "images") + MANIFEST + " SELECT * FROM manifest")
def manifest_boxes(spark, sf_dir):
    return tiling.manifest_boxes(view(spark, sf_dir, "rois"), view(spark, sf_dir, "images"))


VISIBLE = 0.6
_INTER = "CAST(greatest(0, least(r.x1, b.x2) - greatest(r.x0, b.x1)) * greatest(0, least(r.y1, b.y2) - greatest(r.y0, b.y1)) AS DOUBLE)"
_INSIDE = "(b.x1 + b.x2) / 2.0::DOUBLE BETWEEN r.x0 AND r.x1 AND (b.y1 + b.y2) / 2.0::DOUBLE BETWEEN r.y0 AND r.y1"


def _label(axis, n):
    a, b = f"least(greatest(b.{axis}1, r.{axis}0), r.{axis}1)", f"least(greatest(b.{axis}2, r.{axis}0), r.{axis}1)"
    side = f"greatest(1, r.{axis}1 - r.{axis}0 + 1)"
    return f"{_unit(f'({_d(f'{a} + {b}')} / 2 - r.{axis}0) / {side}')} AS c{axis}, {_unit(f'{_d(f'{b} - {a}')} / {side}')} AS {n}"


REGION = f"r.image_id, b.box_id, b.cls, {_label('x', 'w')}, {_label('y', 'h')}"
ROIS = ctes("rois", "images", "gt_boxes") + MANIFEST
SHARE_OK = f"{_INTER} > 0 AND {_INTER} / greatest(CAST((b.x2 - b.x1) * (b.y2 - b.y1) AS DOUBLE), 1e-6) >= {VISIBLE}"


@query("roi_labels", ROIS + f" SELECT {REGION} FROM manifest r JOIN gt_boxes b USING (image_id) WHERE ({SHARE_OK}) OR ({_INSIDE})")
def roi_labels(spark, sf_dir):
    return tiling.roi_labels(manifest_boxes(spark, sf_dir), view(spark, sf_dir, "gt_boxes"), VISIBLE)


@query("roi_labels_nearest", ROIS + f""", kept AS (SELECT {REGION}, FALSE AS forced FROM manifest r JOIN gt_boxes b USING (image_id) WHERE {SHARE_OK.replace(str(VISIBLE), '0.999')})
SELECT * FROM kept UNION ALL SELECT * FROM (SELECT {REGION}, TRUE AS forced FROM manifest r JOIN gt_boxes b USING (image_id) WHERE {_INTER} > 0 AND r.image_id NOT IN (SELECT image_id FROM kept) QUALIFY row_number() OVER (PARTITION BY r.image_id ORDER BY {_INTER} DESC, b.box_id) = 1)""")
def roi_labels_nearest(spark, sf_dir):
    return tiling.roi_labels_nearest(manifest_boxes(spark, sf_dir), view(spark, sf_dir, "gt_boxes"), 0.999)


#: Shapes of boxes, by their kind: the whole box, one corner cut off (``CUT`` pixels along both sides), and a notch from the top
#: that leaves ``LEG`` pixels on either side and is ``DEEP`` pixels deep.
CUT, LEG, DEEP = 60, 70, 120


def _shape(kind: Column) -> Column:
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in tiling.CORNERS)

    def ring(*points):
        return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points))

    cut = ring((x1 + CUT, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1 + CUT))
    notched = ring((x1, y1), (x1 + LEG, y1), (x1 + LEG, y1 + DEEP), (x2 - LEG, y1 + DEEP), (x2 - LEG, y1), (x2, y1), (x2, y2), (x1, y2))
    return F.when(kind == 1, cut).when(kind == 2, notched)


def _clipped_sql(rows: str, out: str) -> str:
    """CTEs that add px1, py1, px2, py2, area and parts to ``rows`` (x1, y1, x2, y2, kind and the window wx1, wy1, wx2, wy2), in closed form."""
    w, h, s = "(c - a)", "(d - b)", "(k - a - b)"
    lost = f"CASE WHEN {s} <= 0 THEN 0.0::DOUBLE ELSE ({s} * {s} - greatest({s} - {w}, 0) * greatest({s} - {w}, 0) - greatest({s} - {h}, 0) * greatest({s} - {h}, 0)) / 2.0::DOUBLE END"
    gap = "greatest(least(c, n2) - greatest(a, n1), 0) * greatest(least(d, ny) - b, 0)"
    left, right = "greatest(least(c, n1) - a, 0)", "greatest(c - greatest(a, n2), 0)"
    whole = "kind = 0 OR (kind = 2 AND d > ny)"
    return f"""{out}_r AS (SELECT *, greatest(x1, wx1) AS a, greatest(y1, wy1) AS b, least(x2, wx2) AS c, least(y2, wy2) AS d, x1 + y1 + {CUT} AS k, x1 + {LEG} AS n1, x2 - {LEG} AS n2, y1 + {DEEP} AS ny FROM {rows}),
{out}_s AS (SELECT *, {left} AS lw, {right} AS rw FROM {out}_r WHERE a < c AND b < d),
{out} AS (SELECT * EXCLUDE (a, b, c, d, k, n1, n2, ny, lw, rw),
  CASE WHEN kind = 1 THEN greatest(a, k - d) WHEN {whole} OR lw >= rw THEN a ELSE greatest(a, n2) END AS px1,
  CASE WHEN kind = 1 THEN greatest(b, k - c) WHEN kind = 2 AND d > ny AND a >= n1 AND c <= n2 THEN greatest(b, ny) ELSE b END AS py1,
  CASE WHEN kind = 1 OR {whole} OR lw < rw THEN c ELSE least(c, n1) END AS px2, d AS py2,
  CASE WHEN kind = 1 THEN {w} * {h} - ({lost}) WHEN kind = 0 THEN CAST({w} * {h} AS DOUBLE) WHEN d > ny THEN CAST({w} * {h} - {gap} AS DOUBLE) ELSE CAST(greatest(lw, rw) * {h} AS DOUBLE) END AS area,
  CASE WHEN kind = 1 THEN CAST(c + d > k AS INTEGER) WHEN {whole} THEN 1 ELSE CAST(lw > 0 AS INTEGER) + CAST(rw > 0 AS INTEGER) END AS parts FROM {out}_s)"""


@query("clip_polygons", ctes("images", "gt_boxes") + f""", {GRID}, met AS (SELECT g.image_id, tx, ty, box_id, 1 + pk % 2 AS kind, x1, y1, x2, y2, tx AS wx1, ty AS wy1, tx2 AS wx2, ty2 AS wy2 FROM grid g JOIN gt_boxes b USING (image_id)),
{_clipped_sql('met', 'done')} SELECT image_id, tx, ty, box_id, parts, area, CAST(px1 AS DOUBLE) AS x1, CAST(py1 AS DOUBLE) AS y1, CAST(px2 AS DOUBLE) AS x2, CAST(py2 AS DOUBLE) AS y2 FROM done WHERE parts > 0""")
def clip_polygons(spark, sf_dir):
    """Boxes with a corner cut off (convex) and with a notch (which can fall into two parts), clipped to the tiles they overlap."""
    b = view(spark, sf_dir, "gt_boxes").select("image_id", "box_id", *tiling.CORNERS, _shape(1 + F.col("pk") % 2).alias("poly"))
    met = meet(tile_grid(spark, sf_dir), b, ("tx", "ty", "tx2", "ty2"), tiling.CORNERS, cell=TILE)
    out = tiling.clip_polygons(met, ["image_id", "tx", "ty", "box_id"], ("tx", "ty", "tx2", "ty2"))
    box = fb.poly_bbox("poly")
    return out.select("image_id", "tx", "ty", "box_id", "parts", F.abs(signed_area(F.col("poly"))).alias("area"), *(v.alias(c) for v, c in zip(box, tiling.CORNERS, strict=True)))


@query("tile_labels_poly", ctes("images", "gt_boxes") + f""", {GRID}, met AS (SELECT g.image_id, tx, ty, box_id, cls, pk % 3 AS kind, x1, y1, x2, y2, tx AS wx1, ty AS wy1, tx + {TILE} AS wx2, ty + {TILE} AS wy2 FROM (SELECT DISTINCT image_id, tx, ty FROM grid) g JOIN gt_boxes b USING (image_id)),
{_clipped_sql('met', 'done')}, l AS (SELECT image_id, tx, ty, box_id, cls, ({_d('px1 + px2')} / 2 - tx) / {TILE} AS cx, ({_d('py1 + py2')} / 2 - ty) / {TILE} AS cy, {_d('px2 - px1')} / {TILE} AS w, {_d('py2 - py1')} / {TILE} AS h, CASE WHEN kind > 0 THEN round(area / {TILE} / {TILE}, 12) END AS share FROM done WHERE parts > 0) SELECT * FROM l WHERE w * h >= 0.0015""")
def tile_labels_poly(spark, sf_dir):
    """Labels of tiles where a third of the boxes are whole, a third lack a corner and a third have a notch; share is the part's area."""
    b = view(spark, sf_dir, "gt_boxes").withColumn("poly", _shape(F.col("pk") % 3))
    out = tiling.tile_labels(tile_grid(spark, sf_dir), b, TILE)
    return out.withColumn("share", F.round(F.abs(signed_area(F.col("poly"))), 12)).drop("poly")


@query("retile_poly", ctes("images", "gt_boxes") + f""", {GRID}, met AS (SELECT g.image_id, tx, ty, box_id, pk % 3 AS kind, x1, y1, x2, y2, tx AS wx1, ty AS wy1, tx + {TILE} AS wx2, ty + {TILE} AS wy2 FROM (SELECT DISTINCT image_id, tx, ty FROM grid) g JOIN gt_boxes b USING (image_id)),
{_clipped_sql('met', 'done')}, labels AS (SELECT image_id, tx, ty, box_id, ({_d('px1 + px2')} / 2 - tx) / {TILE} AS cx, ({_d('py1 + py2')} / 2 - ty) / {TILE} AS cy, {_d('px2 - px1')} / {TILE} AS w, {_d('py2 - py1')} / {TILE} AS h FROM done WHERE parts > 0),
best AS (SELECT image_id, tx, ty, w * h AS area, cx, cy FROM labels WHERE w * h >= 0.0015 QUALIFY row_number() OVER (PARTITION BY image_id, tx, ty ORDER BY w * h DESC, box_id) = 1),
small AS (SELECT image_id, tx, ty, area, {_new('tx', 'width', 'cx')} AS new_tx, {_new('ty', 'height', 'cy')} AS new_ty FROM best JOIN images USING (image_id) WHERE area < {LEAST}),
again AS (SELECT s.image_id, new_tx, new_ty, pk % 3 AS kind, x1, y1, x2, y2, new_tx AS wx1, new_ty AS wy1, new_tx + {TILE} AS wx2, new_ty + {TILE} AS wy2 FROM (SELECT DISTINCT image_id, new_tx, new_ty FROM small) s JOIN gt_boxes b USING (image_id)),
{_clipped_sql('again', 'redone')}, found AS (SELECT image_id, new_tx, new_ty, max({_d('px2 - px1')} / {TILE} * ({_d('py2 - py1')} / {TILE})) AS new_area FROM redone WHERE parts > 0 AND {_d('px2 - px1')} / {TILE} * ({_d('py2 - py1')} / {TILE}) >= 0.0015 GROUP BY ALL),
adopted AS (SELECT image_id, tx, ty, new_tx, new_ty FROM small JOIN found USING (image_id, new_tx, new_ty) WHERE new_area >= greatest(area, {LEAST})),
placed AS (SELECT b.image_id, b.tx, b.ty, coalesce(new_tx, b.tx) AS new_tx, coalesce(new_ty, b.ty) AS new_ty, new_tx IS NOT NULL AS moved FROM best b LEFT JOIN adopted a ON a.image_id = b.image_id AND a.tx = b.tx AND a.ty = b.ty)
SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY image_id, new_tx, new_ty ORDER BY moved DESC, ty, tx) = 1""")
def retile_poly(spark, sf_dir):
    b = view(spark, sf_dir, "gt_boxes").withColumn("poly", _shape(F.col("pk") % 3))
    return tiling.retile(tile_grid(spark, sf_dir), b, view(spark, sf_dir, "images"), TILE, LEAST)


@query("crop_letterbox_poly", ctes("images", "gt_boxes") + CROPS + f""", drawn AS (SELECT p.*, b.pk % 3 AS kind FROM panels p JOIN gt_boxes b USING (image_id, box_id) UNION ALL SELECT *, 0 AS kind FROM tags),
met AS (SELECT c.image_id, panel_id, cx1, cy1, cx2 - cx1 AS cw, cy2 - cy1 AS ch, box_id, cls, kind, x1, y1, x2, y2, cx1 AS wx1, cy1 AS wy1, cx2 AS wx2, cy2 AS wy2 FROM crops c JOIN drawn b USING (image_id)), {_clipped_sql('met', 'done')},
s AS (SELECT *, {BOXED}.0::DOUBLE / greatest(cw, ch) AS scale FROM done WHERE parts > 0 AND area >= 1), o AS (SELECT *, floor(({BOXED} - trunc(cw * scale)) / 2) AS lft, floor(({BOXED} - trunc(ch * scale)) / 2) AS top FROM s),
l AS (SELECT image_id, panel_id, box_id, cls, (({_d('px1 + px2')} / 2 - cx1) * scale + lft) / {BOXED} AS cx, (({_d('py1 + py2')} / 2 - cy1) * scale + top) / {BOXED} AS cy, (px2 - px1) * scale / {BOXED} AS w, (py2 - py1) * scale / {BOXED} AS h, CASE cls WHEN 0 THEN round(area * scale * scale / {BOXED} / {BOXED}, 6) END AS share FROM o) SELECT * FROM l WHERE w >= 1e-4 AND h >= 1e-4""")
def crop_letterbox_poly(spark, sf_dir):
    panels, tags = _classed(spark, sf_dir)
    kind = view(spark, sf_dir, "gt_boxes").select("image_id", "box_id", (F.col("pk") % 3).alias("kind"))
    drawn = panels.join(kind, ["image_id", "box_id"]).withColumn("poly", _shape(F.col("kind"))).drop("kind")
    out = tiling.letterbox(crop_windows(spark, sf_dir), drawn.unionByName(tags, allowMissingColumns=True), BOXED)
    return out.withColumn("share", F.round(F.abs(signed_area(F.col("poly"))), 6)).drop("poly")
