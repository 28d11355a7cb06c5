"""Queries on colours, regions, experiments, keys and augmentation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.boxes import bbox_poly
from gridloom.operators import augment, colors, keys, runs, tiling
from gridloom.operators.ranks import ranked
from gridloom.plans.fixtures import ctes, view
from gridloom.plans.registry import Registry
from gridloom.plans.tilings import MANIFEST, VISIBLE, manifest_boxes
from gridloom.sources import files

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

Q, N, TOL, LOW, HIGH = 16, 5, 8, 32, 240
HIST = ctes("pixels") + f", hist AS (SELECT image_id, CAST(floor(r / {Q}) * {Q} AS BIGINT) AS r, CAST(floor(g / {Q}) * {Q} AS BIGINT) AS g, CAST(floor(b / {Q}) * {Q} AS BIGINT) AS b, count(*) AS pixels FROM pixels GROUP BY ALL)"


@query("color_hist", ctes("pixels") + " SELECT image_id, r, g, b, count(*) AS pixels FROM pixels GROUP BY ALL")
def color_hist(spark, sf_dir):
    return colors.color_hist(view(spark, sf_dir, "pixels"))


TOP = HIST + f", top AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pixels DESC, r, g, b) AS INTEGER) AS rank FROM hist WHERE abs(r - g) <= {TOL} AND abs(r - b) <= {TOL} AND r BETWEEN {LOW} AND {HIGH} QUALIFY rank <= {N}), totals AS (SELECT image_id, CAST(sum(pixels) AS BIGINT) AS total_pixels FROM hist GROUP BY image_id)"


def _top(spark, sf_dir, n=N):
    return colors.top_colors(colors.color_hist(view(spark, sf_dir, "pixels"), Q), n, True, TOL, LOW, HIGH)


def _cells(i):
    at = f"FILTER (rank = {i})"
    return f"max('(' || r || ',' || g || ',' || b || ')') {at} AS color{i}_rgb, max(printf('#%02X%02X%02X', r, g, b)) {at} AS color{i}_hex, max(pixels * 100.0::DOUBLE / total_pixels) {at} AS color{i}_pct"


@query("top_colors", TOP + f" SELECT image_id, max(total_pixels) AS total_pixels, {', '.join(_cells(i + 1) for i in range(N))} FROM top JOIN totals USING (image_id) GROUP BY image_id")
def top_colors(spark, sf_dir):
    return colors.top_colors_wide(_top(spark, sf_dir), N)


@query("color_text", ctes("pixels") + " SELECT DISTINCT printf('#%02X%02X%02X', r, g, b) AS hex, '(' || r || ',' || g || ',' || b || ')' AS text, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM pixels")
def color_text(spark, sf_dir):
    text = view(spark, sf_dir, "pixels").select(*colors.RGB).distinct().select(colors.to_hex().alias("hex"), colors.to_text().alias("text"))
    return text.withColumn("_rgb", colors.from_text("text")).select("hex", "text", "_rgb.*")


REACH, PAD, BLACK = 10, 4, 60
MASK = TOP + f""", mask AS (SELECT * FROM pixels p WHERE 0.299::DOUBLE * p.r + 0.587::DOUBLE * p.g + 0.114::DOUBLE * p.b >= {BLACK} AND EXISTS (SELECT 1 FROM top c WHERE c.rank <= 2 AND c.image_id = p.image_id
AND abs(p.r - c.r) <= {REACH} + CASE WHEN greatest(abs(c.r - c.g), abs(c.g - c.b), abs(c.b - c.r)) <= 8 THEN {PAD} ELSE 0 END AND abs(p.g - c.g) <= {REACH} + CASE WHEN greatest(abs(c.r - c.g), abs(c.g - c.b), abs(c.b - c.r)) <= 8 THEN {PAD} ELSE 0 END
AND abs(p.b - c.b) <= {REACH} + CASE WHEN greatest(abs(c.r - c.g), abs(c.g - c.b), abs(c.b - c.r)) <= 8 THEN {PAD} ELSE 0 END))"""


@query("color_mask", MASK + " SELECT image_id, x, y, r, g, b FROM mask")
def color_mask(spark, sf_dir):
    palette = _top(spark, sf_dir, 2)
    return colors.color_mask(view(spark, sf_dir, "pixels"), palette, REACH, PAD, black_cutoff=BLACK).select("image_id", "x", "y", *colors.RGB)


SAT, HUE, VALUE = 180, (20, 150), (40, 230)


def _scaled(n, top, by):
    return f"CASE WHEN {by} = 0 THEN 0 ELSE CAST(floor((({n}) * round_even({top * 4096}.0::DOUBLE / {by}, 0) + 2048) / 4096) AS BIGINT) END"


HSV = f""", hsv_a AS (SELECT *, greatest(r, g, b) AS hv, greatest(r, g, b) - least(r, g, b) AS hd FROM mask),
hsv_b AS (SELECT *, {_scaled("CASE WHEN hv = r THEN g - b WHEN hv = g THEN b - r + 2 * hd ELSE r - g + 4 * hd END", 30, "hd")} AS hh, {_scaled("hd", 255, "hv")} AS hs FROM hsv_a)
SELECT image_id, x, y, r, g, b FROM hsv_b WHERE hs <= {SAT} AND CASE WHEN hh < 0 THEN hh + 180 ELSE hh END BETWEEN {HUE[0]} AND {HUE[1]} AND hv BETWEEN {VALUE[0]} AND {VALUE[1]}"""


@query("color_mask_hsv", MASK + HSV)
def color_mask_hsv(spark, sf_dir):
    palette = _top(spark, sf_dir, 2)
    return colors.color_mask(view(spark, sf_dir, "pixels"), palette, REACH, PAD, black_cutoff=BLACK, most_sat=SAT, hue=HUE, value=VALUE).select("image_id", "x", "y", *colors.RGB)


def _side(c):
    low, high = f"greatest(0, least(1023, CAST(floor(lo_{c} * 2.0::DOUBLE) AS BIGINT)))", f"greatest(0, least(1023, CAST(ceil(hi_{c} * 2.0::DOUBLE) AS BIGINT)))"
    more = f"CAST(round_even(({high} - {low} + 1) * 0.05::DOUBLE, 0) AS BIGINT)"
    return f"CASE WHEN masked > 0 THEN greatest(0, {low} - {more}) END AS {c}0, CASE WHEN masked > 0 THEN least(1023, {high} + {more}) END AS {c}1"


@query("mask_roi", MASK + f""", places AS (SELECT image_id, count(DISTINCT (x, y)) AS places FROM pixels GROUP BY image_id), found AS (SELECT image_id, count(DISTINCT (x, y)) AS masked, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM mask GROUP BY image_id),
j AS (SELECT image_id, coalesce(masked, 0) AS masked, CAST(coalesce(masked, 0) AS DOUBLE) / places AS coverage, lo_x, hi_x, lo_y, hi_y FROM places LEFT JOIN found USING (image_id)) SELECT image_id, masked, coverage, {_side('x')}, {_side('y')} FROM j""")
def mask_roi(spark, sf_dir):
    return colors.mask_roi(color_mask(spark, sf_dir), view(spark, sf_dir, "pixels"), 0.5, 0.05, 1024, 1024)


@query("manifest_stats", ctes("rois", "images", "gt_boxes") + MANIFEST + ", kept AS (SELECT r.image_id FROM manifest r JOIN gt_boxes b USING (image_id) WHERE CAST(greatest(0, least(r.x1, b.x2) - greatest(r.x0, b.x1)) * greatest(0, least(r.y1, b.y2) - greatest(r.y0, b.y1)) AS DOUBLE) / greatest(CAST((b.x2 - b.x1) * (b.y2 - b.y1) AS DOUBLE), 1e-6) >= 0.9 AND greatest(0, least(r.x1, b.x2) - greatest(r.x0, b.x1)) * greatest(0, least(r.y1, b.y2) - greatest(r.y0, b.y1)) > 0), c AS (SELECT image_id, (SELECT count(*) FROM gt_boxes b WHERE b.image_id = m.image_id) AS src_box_count, (SELECT count(*) FROM kept k WHERE k.image_id = m.image_id) AS kept_box_count FROM manifest m) SELECT *, CASE WHEN src_box_count > 0 AND kept_box_count = 0 THEN 'all boxes lost' END AS remap_note FROM c")
def manifest_stats(spark, sf_dir):
    rois, boxes = manifest_boxes(spark, sf_dir), view(spark, sf_dir, "gt_boxes")
    return colors.manifest_stats(rois.select("image_id"), boxes, tiling.roi_labels(rois, boxes, 0.9, by_centre=False))


LRS, WDS, GAINS = ["0.001", "0.0015", "0.002"], ["0.0003", "0.0005", "0.001"], ["1.0", "1.3", "1.6"]


def _values(name, items):
    return f"(VALUES {', '.join(f'({i}, {chr(39)}{v}{chr(39)})' for i, v in enumerate(items))}) {name}(i, v)"


@query("experiment_grid", ctes("runs") + f", grid AS (SELECT CAST((a.i * 3 + b.i) * 3 + c.i + 1 AS BIGINT) AS exp_num, replace('lr' || a.v || '_wd' || b.v || '_cls' || c.v, '.', 'p') AS experiment_id, CAST(a.v AS DOUBLE) AS lr0, CAST(b.v AS DOUBLE) AS weight_decay, CAST(c.v AS DOUBLE) AS cls_gain FROM {_values('a', LRS)}, {_values('b', WDS)}, {_values('c', GAINS)}) SELECT grid.*, (SELECT count(*) FROM runs WHERE runs.exp_num % 29 + 1 = grid.exp_num) AS runs FROM grid")
def experiment_grid(spark, sf_dir):
    """The grid, and how many runs each of its experiments already has."""
    done = view(spark, sf_dir, "runs").select((F.col("exp_num") % 29 + 1).alias("exp_num"))
    return runs.progress(runs.experiment_grid(spark, LRS, WDS, GAINS), done)


@query("promote_runs", ctes("runs") + ", base AS (SELECT median(worst_bin_recall) AS r, median(fp_per_image) AS f, count(*) AS n FROM runs), judged AS (SELECT runs.*, worst_bin_recall - r >= 0.05::DOUBLE AND fp_per_image <= f AS qualified FROM runs, base WHERE n >= 3) SELECT * FROM judged WHERE qualified OR NOT (SELECT bool_or(qualified) FROM judged) ORDER BY worst_bin_recall DESC, fp_per_image, exp_num LIMIT 3")
def promote_runs(spark, sf_dir):
    return runs.promote(view(spark, sf_dir, "runs"))


@query("best_run", ctes("runs") + ", both_phases AS (SELECT * FROM runs UNION ALL SELECT exp_num, 'B', worst_bin_recall / 2 + 0.5::DOUBLE, fp_per_image FROM runs WHERE exp_num % 3 = 0) SELECT * FROM both_phases WHERE phase = 'B' ORDER BY worst_bin_recall DESC, exp_num LIMIT 1")
def best_run(spark, sf_dir):
    a = view(spark, sf_dir, "runs")
    b = a.where("exp_num % 3 = 0").select("exp_num", F.lit("B").alias("phase"), (F.col("worst_bin_recall") / 2 + 0.5).alias("worst_bin_recall"), "fp_per_image")
    return runs.best_run(a.unionByName(b))


FILES = "SELECT image_id AS stem, 'jpg' AS ext FROM images WHERE image_id % 2 = 0 UNION ALL SELECT image_id, 'jpeg' FROM images WHERE image_id % 5 = 0 UNION ALL SELECT image_id, 'png' FROM images WHERE image_id % 7 = 0"


@query("ingest_pending", ctes("images") + f", f AS ({FILES}), best AS (SELECT stem, arg_min(ext, CASE ext WHEN 'jpg' THEN 1 WHEN 'jpeg' THEN 2 ELSE 3 END) AS ext FROM f GROUP BY stem) SELECT p.image_id AS stem, ext, CASE WHEN ext IS NULL THEN 'failed' ELSE 'ingested' END AS status FROM images p LEFT JOIN best ON stem = p.image_id WHERE p.image_id % 3 = 0 AND p.image_id % 9 <> 0")
def ingest_pending(spark, sf_dir):
    stems = view(spark, sf_dir, "images").select(F.col("image_id").alias("stem"))
    found = stems.where("stem % 2 = 0").withColumn("ext", F.lit("jpg")).unionByName(stems.where("stem % 5 = 0").withColumn("ext", F.lit("jpeg"))).unionByName(stems.where("stem % 7 = 0").withColumn("ext", F.lit("png")))
    return keys.ingest(stems.where("stem % 3 = 0"), found, stems.where("stem % 9 = 0"))


@query("assign_keys", ctes("images") + r", n AS (SELECT 'p' || CAST(image_id % 997 AS VARCHAR) || '_' || CAST(image_id AS VARCHAR) AS name, image_id % 997 AS number, image_id AS page FROM images WHERE image_id % 3 = 0), m AS (SELECT max(CAST(substr(sheet, 2) AS BIGINT)) AS most FROM images), d AS (SELECT number, row_number() OVER (ORDER BY number) AS nth FROM (SELECT DISTINCT number FROM n)) SELECT name, 'x' || CAST(most + nth AS VARCHAR) || '_' || CAST(page AS VARCHAR) AS new_name FROM n JOIN d USING (number), m")
def assign_keys(spark, sf_dir):
    images = view(spark, sf_dir, "images")
    new = images.where("image_id % 3 = 0").select(F.concat(F.lit("p"), (F.col("image_id") % 997).cast("string"), F.lit("_"), F.col("image_id").cast("string")).alias("name"))
    return keys.assign_keys(new, images.select(F.col("sheet").alias("name")).distinct())


#: Names with several numbers, none, leading zeros and upper case, from sheets and sides of images.
_NAMES = """SELECT image_id, CASE image_id % 5 WHEN 0 THEN concat('Plan', CAST(width AS STRING), 'b', CAST(height AS STRING)) WHEN 1 THEN concat('plan', lpad(CAST(width AS STRING), 6, '0'), '-', sheet)
 WHEN 2 THEN concat(CAST(height AS STRING), sheet) WHEN 3 THEN concat('cover', substr('abcdefghij', CAST(image_id % 7 AS INT) + 1, 3)) ELSE concat(sheet, '.', CAST(height AS STRING), '.', CAST(width AS STRING), 'z') END AS name FROM images"""
_RUNS = "list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN chr(1) || lpad(CAST(length(CAST(CAST(r AS HUGEINT) AS VARCHAR)) AS VARCHAR), 4, '0') || CAST(CAST(r AS HUGEINT) AS VARCHAR) ELSE r END)"


@query("natural_order", ctes("images") + f", n AS ({_NAMES}), k AS (SELECT *, array_to_string({_RUNS}, '') AS sort_text FROM n) SELECT image_id, name, row_number() OVER (ORDER BY sort_text, name, image_id) AS nth FROM k")
def natural_order(spark, sf_dir):
    """The place of each name in natural order."""
    names = spark.sql(_NAMES.replace("FROM images", "FROM {i}"), i=view(spark, sf_dir, "images"))
    return ranked(names.withColumn("natural", keys.natural_key("name")), ["natural", "name", "image_id"], "nth").drop("natural")


@query("unique_names", ctes("images") + ", r AS (SELECT image_id, sheet AS name, row_number() OVER (PARTITION BY sheet ORDER BY image_id) AS nth, CAST(substr(sheet, 2) AS BIGINT) % 2 = 0 AS had, CAST(substr(sheet, 2) AS BIGINT) % 4 = 0 AS had_one FROM images), k AS (SELECT *, nth - CASE WHEN had THEN 0 ELSE 1 END AS k FROM r), z AS (SELECT *, k + CASE WHEN had_one AND k >= 1 THEN 1 ELSE 0 END AS kk FROM k) SELECT image_id, name, CASE WHEN kk = 0 THEN name ELSE name || '_' || CAST(kk AS VARCHAR) END AS new_name FROM z")
def unique_names(spark, sf_dir):
    images = view(spark, sf_dir, "images").select("image_id", F.col("sheet").alias("name"))
    number = F.substring("name", 2, 9).cast("long")
    had = images.where(number % 2 == 0).select("name").distinct()
    one = images.where(number % 4 == 0).select(F.concat("name", F.lit("_1")).alias("name")).distinct()
    return keys.unique_names(images, had.unionByName(one), ["image_id"])


@query("augment_labels")
def augment_labels(spark, sf_dir):
    """Copies of each image with drawn transforms, and the boxes that their labels then have."""
    b, images = view(spark, sf_dir, "gt_boxes"), view(spark, sf_dir, "images")
    tags = b.where("pk % 4 = 0").groupBy("image_id").agg(F.count(F.lit(1)).alias("tags"))
    copies = augment.drawn(augment.fan_out(images.join(tags, "image_id", "left").fillna(0, ["tags"]), 2), 17, 8.0, 0.1, 0.05)
    rows = copies.join(b.select("image_id", "box_id", "cls", bbox_poly(tiling.CORNERS).alias("poly")), "image_id")
    return augment.transform_polygons(rows).drop("poly")


def _moved(axis, side):
    """The ends of a panel's side, held to the frame and to the moved image."""

    def at(v):
        return f"(scale * ({v} - {side} / 2.0::DOUBLE) + {side} / 2.0::DOUBLE + d{axis} * {side})"

    low, high = f"greatest(0.0::DOUBLE, {at(0)})", f"least(CAST({side} AS DOUBLE), {at(side)})"
    return {n: f"round(least(greatest({at(f'{axis}{n}')}, {low}), {high}), 6)" for n in (1, 2)}


_X, _Y = _moved("x", "width"), _moved("y", "height")


@query("augment_fixed", ctes("gt_boxes", "images") + f""", t AS (SELECT image_id, count(*) AS n FROM gt_boxes WHERE pk % 4 = 0 GROUP BY image_id),
n AS (SELECT i.image_id, width, height, 2 + CASE WHEN coalesce(n, 0) >= 2 THEN 1 ELSE 0 END + CASE WHEN coalesce(n, 0) >= 4 THEN 2 ELSE 0 END AS copies FROM images i LEFT JOIN t USING (image_id)),
copies AS (SELECT image_id, width, height, aug, 1.0::DOUBLE + aug * 0.25::DOUBLE AS scale, aug * 0.125::DOUBLE AS dx, -0.0625::DOUBLE AS dy FROM n JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS aug) a ON aug < copies),
moved AS (SELECT image_id, aug, box_id, cls, {_X[1]} AS x1, {_Y[1]} AS y1, {_X[2]} AS x2, {_Y[2]} AS y2 FROM copies JOIN gt_boxes USING (image_id)) SELECT * FROM moved WHERE x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) >= 4""")
def augment_fixed(spark, sf_dir):
    """``augment_labels`` with parameters that depend on the number of the copy alone."""
    b, images = view(spark, sf_dir, "gt_boxes"), view(spark, sf_dir, "images")
    tags = b.where("pk % 4 = 0").groupBy("image_id").agg(F.count(F.lit(1)).alias("tags"))
    copies = augment.fan_out(images.join(tags, "image_id", "left").fillna(0, ["tags"]), 2)
    copies = copies.withColumns({"angle": F.lit(0.0), "scale": F.lit(1.0) + F.col("aug") * F.lit(0.25), "dx": F.col("aug") * F.lit(0.125), "dy": F.lit(-0.0625)})
    rows = copies.join(b.select("image_id", "box_id", "cls", bbox_poly(tiling.CORNERS).alias("poly")), "image_id")
    return augment.transform_polygons(rows).drop("poly")


TARGET = 640
#: cos and sin of a turn with whole numbers (3, 4, 5), to either side.
COS, SIN = 0.8, 0.6


def _turned(x, y):
    """SQL of a moved point: fitted coordinates within the square -> the frame."""
    half = TARGET / 2
    px, py = f"(({x}) - {half})", f"(({y}) - {half})"
    return f"{{'x': scale * {COS}::DOUBLE * {px} + scale * turn * {py} + {half} + dx * {TARGET}, 'y': scale * {COS}::DOUBLE * {py} - scale * turn * {px} + {half} + dy * {TARGET}}}"


def _side_of(p, h):
    return f"({h}.a * {p}.x + {h}.b * {p}.y + {h}.c)"


_P, _Q, _H = "ring[i]", "ring[i % len(ring) + 1]", "planes[n + 1]"
_DP, _DQ = _side_of(_P, _H), _side_of(_Q, _H)
_HALF = f"""flatten(list_transform(range(1, len(ring) + 1), lambda i: list_concat(CASE WHEN {_DP} >= 0 THEN [{_P}] ELSE [] END,
  CASE WHEN ({_DP} > 0 AND {_DQ} < 0) OR ({_DP} < 0 AND {_DQ} > 0) THEN [{{'x': {_P}.x + {_DP} / ({_DP} - {_DQ}) * ({_Q}.x - {_P}.x), 'y': {_P}.y + {_DP} / ({_DP} - {_DQ}) * ({_Q}.y - {_P}.y)}}] ELSE [] END)))"""
_AREA = "abs(list_sum(list_transform(range(1, len(ring) + 1), lambda i: ring[i].x * ring[i % len(ring) + 1].y - ring[i % len(ring) + 1].x * ring[i].y))) / 2"
_EDGE = "list_transform(range(1, 5), lambda i: {'a': quad[i].y - quad[i % 4 + 1].y, 'b': quad[i % 4 + 1].x - quad[i].x, 'c': -((quad[i].y - quad[i % 4 + 1].y) * quad[i].x + (quad[i % 4 + 1].x - quad[i].x) * quad[i].y)})"
_ENDS = ", ".join(f"list_{f}(list_transform(ring, lambda p: p.{axis})) AS {axis}{n}" for n, f in ((1, "min"), (2, "max")) for axis in "xy")


def _unit_held(c):
    return f"round(CASE cls WHEN 1 THEN least(greatest({c}, 0.0::DOUBLE), {TARGET}.0::DOUBLE) ELSE {c} END, 6) + 0.0::DOUBLE AS {c}"


@query("augment_turned", ctes("gt_boxes", "images") + f""", t AS (SELECT image_id, count(*) AS n FROM gt_boxes WHERE pk % 4 = 0 GROUP BY image_id),
c AS (SELECT i.image_id, width, height, 2 + CASE WHEN coalesce(n, 0) >= 2 THEN 1 ELSE 0 END + CASE WHEN coalesce(n, 0) >= 4 THEN 2 ELSE 0 END AS copies, least({TARGET}.0::DOUBLE / height, {TARGET}.0::DOUBLE / width) AS fit FROM images i LEFT JOIN t USING (image_id)),
o AS (SELECT *, CAST(trunc(width * fit) AS BIGINT) AS cw, CAST(trunc(height * fit) AS BIGINT) AS ch FROM c),
f AS (SELECT image_id, fit, aug, 1.0::DOUBLE + aug * 0.25::DOUBLE AS scale, aug * 0.0625::DOUBLE AS dx, -0.03125::DOUBLE AS dy, CASE WHEN aug % 2 = 0 THEN {SIN}::DOUBLE ELSE -{SIN}::DOUBLE END AS turn, CAST(floor(({TARGET} - cw) / 2) AS BIGINT) AS ox, CAST(floor(({TARGET} - ch) / 2) AS BIGINT) AS oy, cw, ch FROM o JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS aug) a ON aug < copies),
q AS (SELECT *, [{_turned('ox', 'oy')}, {_turned('ox + cw', 'oy')}, {_turned('ox + cw', 'oy + ch')}, {_turned('ox', 'oy + ch')}] AS quad FROM f),
w AS (SELECT *, list_concat([{{'a': 1.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': 0.0::DOUBLE}}, {{'a': -1.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': {TARGET}.0::DOUBLE}}, {{'a': 0.0::DOUBLE, 'b': 1.0::DOUBLE, 'c': 0.0::DOUBLE}}, {{'a': 0.0::DOUBLE, 'b': -1.0::DOUBLE, 'c': {TARGET}.0::DOUBLE}}], {_EDGE}) AS planes FROM q),
b AS (SELECT image_id, box_id, CAST(pk % 4 = 0 AS INTEGER) AS cls, [{{'x': x1 + 60, 'y': y1}}, {{'x': x2, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': x1, 'y': y2}}, {{'x': x1, 'y': y1 + 60}}] AS corners FROM gt_boxes),
m AS (SELECT image_id, aug, box_id, cls, planes, list_transform(corners, lambda p: {_turned('p.x * fit + ox', 'p.y * fit + oy')}) AS ring FROM w JOIN b USING (image_id)),
clip AS (SELECT 0 AS n, * FROM m UNION ALL SELECT n + 1, image_id, aug, box_id, cls, planes, {_HALF} FROM clip WHERE n < 8 AND cls = 0),
e AS (SELECT image_id, aug, box_id, cls, {_ENDS} FROM clip WHERE CASE cls WHEN 1 THEN n = 0 ELSE n = 8 AND len(ring) > 2 AND {_AREA} > 1e-6 END),
r AS (SELECT image_id, aug, box_id, cls, {', '.join(_unit_held(c) for c in ('x1', 'y1', 'x2', 'y2'))} FROM e)
SELECT * FROM r WHERE x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) >= 4""")
def augment_turned(spark, sf_dir):
    """Copies fitted into a square and turned by an exact angle: panels clipped to the moved image, tags as boxes."""
    b, images = view(spark, sf_dir, "gt_boxes"), view(spark, sf_dir, "images")
    tags = b.where("pk % 4 = 0").groupBy("image_id").agg(F.count(F.lit(1)).alias("tags"))
    copies = augment.fan_out(images.join(tags, "image_id", "left").fillna(0, ["tags"]), 2)
    copies = copies.withColumns({"cos": F.lit(COS), "sin": F.when(F.col("aug") % 2 == 0, SIN).otherwise(-SIN), "scale": F.lit(1.0) + F.col("aug") * F.lit(0.25), "dx": F.col("aug") * F.lit(0.0625), "dy": F.lit(-0.03125)})
    poly = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.col("x1") + 60, F.col("y1")), (F.col("x2"), F.col("y1")), (F.col("x2"), F.col("y2")), (F.col("x1"), F.col("y2")), (F.col("x1"), F.col("y1") + 60))))
    rows = copies.join(b.select("image_id", "box_id", (F.col("pk") % 4 == 0).cast("int").alias("cls"), poly.alias("poly")), "image_id")
    return augment.transform_polygons(rows, TARGET).drop("poly")


IMAGES = ", ".join(f"'{t}'" for t in files.IMAGE_TYPES)


@query("list_images", ctes("paths") + rf", f AS (SELECT path, length, string_split(path, '/')[-1] AS name FROM paths) SELECT path, length, regexp_replace(name, '\.[^.]*$', '') AS stem, lower(regexp_extract(name, '\.([^.]*)$', 1)) AS ext FROM f WHERE lower(regexp_extract(name, '\.([^.]*)$', 1)) IN ({IMAGES}) AND NOT regexp_matches(path, '{files.OUTPUT_FOLDERS}')")
def list_images(spark, sf_dir):
    return files.listed(view(spark, sf_dir, "paths"))
