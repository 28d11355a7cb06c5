"""Greedy operators against sequential loops on small random boxes, and hand-worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import boxes as fb
from gridloom.operators import augment, keys, match, metrics, splits, stitch, tiling

BOX = "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double"


def iou(a, b, mode=fb.CONTINUOUS):
    m = 1 if mode == fb.INCLUSIVE else 0
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0]) + m), max(0, min(a[3], b[3]) - max(a[1], b[1]) + m)
    area = lambda t: (t[2] - t[0] + m) * (t[3] - t[1] + m)
    union = area(a) + area(b) - w * h
    if mode == fb.INCLUSIVE:
        return w * h / (union + 1e-6)
    return w * h / (union + 1e-9) if mode == fb.CLIPPED else (w * h / union if w * h > 0 else 0.0)


@pytest.fixture(scope="module")
def dets(spark):
    rng = random.Random(1)
    rows = []
    for image in range(12):
        for d in range(rng.choice([1, 2, 15, 30])):
            x, y = rng.randrange(0, 40, 4), rng.randrange(0, 40, 4)
            rows.append((image, d, float(x), float(y), float(x + rng.choice([8, 12, 16])), float(y + rng.choice([8, 12, 16])), rng.choice([0.1, 0.5, 0.5, 0.9])))
    return rows, spark.createDataFrame(rows, BOX)


def by_image(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (-r[6], r[1])) for k, v in out.items()}


@pytest.mark.parametrize("mode", [fb.INCLUSIVE, fb.CLIPPED])
def test_nms_is_the_loop_and_idempotent(dets, mode):
    rows, df = dets
    want = set()
    for image, boxes in by_image(rows).items():
        kept = []
        for b in boxes:
            if all(iou(k[2:6], b[2:6], mode) <= 1 / 3 for k in kept):
                kept.append(b)
        want |= {(image, b[1]) for b in kept}
    once = stitch.nms(df, 1 / 3, mode)
    assert {(r["image_id"], r["det_id"]) for r in once.collect()} == want
    assert {(r["image_id"], r["det_id"]) for r in stitch.nms(once, 1 / 3, mode).repartition(7).collect()} == want


def test_anchor_clusters_are_the_loop(dets):
    rows, df = dets
    want = {}
    for image, boxes in by_image(rows).items():
        left = list(boxes)
        while left:
            base = left[0]
            mine = [b for b in left if b is base or iou(base[2:6], b[2:6], fb.INCLUSIVE) >= 0.4]
            want |= {(image, b[1]): base[1] for b in mine}
            left = [b for b in left if b not in mine]
    got = stitch.anchored(df, lambda a, b: fb.iou(tuple(a[c] for c in stitch.CORNERS), tuple(b[c] for c in stitch.CORNERS), fb.INCLUSIVE) >= 0.4)
    assert {(r["image_id"], r["det_id"]): r["anchor"] for r in got.collect()} == want


def test_matching_is_the_loop_and_one_to_one(spark, dets):
    rows, df = dets
    rng = random.Random(2)
    truth = [(r[0], r[1] * 3, *[v + rng.choice([0, 2]) for v in r[2:6]]) for r in rows if r[1] % 2 == 0]
    gts = spark.createDataFrame(truth, "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    pairs = match.candidate_pairs(df, gts, 0.25)
    want = set()
    for image in {r[0] for r in rows}:
        every = sorted(((iou(p[2:6], g[2:6]), p[1], g[1]) for p in rows if p[0] == image for g in truth if g[0] == image), reverse=True)
        used_p, used_g = set(), set()
        for v, p, g in every:
            if v >= 0.25 and p not in used_p and g not in used_g:
                used_p.add(p)
                used_g.add(g)
                want.add((image, p, g))
    found = lambda m: {(r["image_id"], r["det_id"], r["box_id"]) for r in m.collect()}
    assert found(match.greedy_matches(pairs)) == want == found(match.mutual_best_matches(pairs))
    cells = match.candidate_pairs_by_cell(df, gts, 0.25, 10)
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, pairs.collect()))
    counts = metrics.image_counts(df.select("image_id").distinct(), gts, df, match.greedy_matches(pairs)).collect()
    assert all(r["tp"] + r["fn"] == r["n_gt"] and r["tp"] + r["fp"] == r["n_pred"] for r in counts)


def test_iou_on_the_threshold_and_touching(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 4.0, 0.5), (1, 2, 4.0, 0.0, 8.0, 4.0, 0.5)], BOX)
    g = spark.createDataFrame([(1, 1, 0.0, 0.0, 4.0, 2.0)], "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    assert [r["det_id"] for r in match.candidate_pairs(a, g, 0.5).collect()] == [1]
    assert match.candidate_pairs(a, g, 0.51).collect() == []


def test_tile_grid_leaves_the_strip_unless_asked(spark):
    images = spark.createDataFrame([(1, 4000, 1000)], "image_id long, width long, height long")
    assert [r["tx"] for r in tiling.tile_grid(images, 1536, 0.3).orderBy("tx").collect()] == [0, 1075, 2150]
    assert [r["tx"] for r in tiling.tile_grid(images, 1536, 0.3, cover_edges=True).orderBy("tx").collect()] == [0, 1075, 2150, 2464]
    assert tiling.stride_of(1536, 0.3) == 1075


def test_clip_polygons_by_hand(spark):
    poly = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    df = spark.createDataFrame([(1, poly, 5.0, 5.0, 20.0, 20.0), (2, poly, 20.0, 20.0, 30.0, 30.0), (3, [(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)], 0.0, 0.0, 4.0, 4.0)], "id long, poly array<struct<x:double,y:double>>, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"]: sorted((p["x"], p["y"]) for p in r["poly"]) for r in tiling.clip_polygons(df, ["id"]).collect()}
    assert got[1] == [(5.0, 5.0), (5.0, 10.0), (10.0, 5.0), (10.0, 10.0)] and 2 not in got
    assert set(got[3]) == {(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)}


def test_exact_rank_for_any_partitioning(spark):
    rows = [(i, (i * 37) % 101) for i in range(500)]
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    for parts in (1, 8, 64):
        df = spark.createDataFrame(rows, "image_id long, k long").repartition(parts)
        assert {r["image_id"]: r["rank"] for r in splits.exact_rank(df, "k", ["image_id"]).collect()} == want


def test_ratio_split_sizes_and_bad_ratios(spark):
    df = spark.range(97).select(F.col("id").alias("image_id"), (F.col("id") * 13 % 89).alias("k"))
    got = {r["split"]: r["count"] for r in splits.ratio_split(df, "k", [("a", 0.7), ("b", 0.2), ("c", 0.1)]).groupBy("split").count().collect()}
    assert got == {"a": 67, "b": 19, "c": 11}
    with pytest.raises(ValueError, match="sum"):
        splits.ratio_split(df, "k", [("a", 0.7), ("b", 0.1)])


def test_whole_sheets_leave_no_leak(spark):
    rows = [(i, f"s{i % 9}", "train" if i % 9 else "val") for i in range(300)]
    images = spark.createDataFrame(rows, "image_id long, sheet string, split string").withColumn("k", F.col("image_id") % 17)
    moved = splits.rebalance(images, images.where("image_id % 3 = 0"), "k", whole_sheets=True)
    assert splits.leakage(moved).count() == 0
    assert splits.rebalance(images, images.where("image_id < 20"), "k").where("split = 'val'").count() == images.where("split = 'val'").count()


def test_unique_names_pass_over_taken_suffixes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "image_id long, name string")
    have = spark.createDataFrame([("a",), ("a_2",), ("c_1",)], "name string")
    got = {r["image_id"]: r["new_name"] for r in keys.unique_names(df, have, ["image_id"]).collect()}
    assert got == {1: "a_1", 2: "a_3", 3: "a_4", 4: "b"}


def test_draws_do_not_depend_on_partitions(spark):
    images = spark.createDataFrame([(i, 100, 80, i % 6) for i in range(40)], "image_id long, width long, height long, tags long")
    a, b = (sorted(map(tuple, augment.drawn(augment.fan_out(images.repartition(n), 2), 1, 8.0, 0.1, 0.05).collect())) for n in (1, 9))
    assert a == b
    per = {r["tags"]: r["count"] for r in augment.fan_out(images, 2).groupBy("tags").count().collect()}
    assert per[0] == 7 * 2 and per[2] == 7 * 3 and per[5] == 6 * 5


def test_class_rules_and_strict_reading(spark):
    from gridloom.operators import labels

    lines = spark.createDataFrame([(1, n, t) for n, t in enumerate(["0 .5 .5 .1 .1", "0.7 .5 .5 .1 .1", "1.0 .5 .5 .1 .1", "2.5 .5 .5 .1 .1", "-0 .5 .5 .1 .1", "x .5 .5 .1 .1", "0 .5", "", "nan .5 .5 .1 .1"])], "image_id long, line_no long, line string")
    read = lambda rule: {r["line_no"]: r["cls"] for r in labels.parse_labels(lines, rule=rule).collect()}
    assert {k: v for k, v in read("rounded").items() if k != 8} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 0}
    assert read("whole") == {0: 0, 4: 0}
    assert {k: v for k, v in read("truncated").items() if k != 8} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 0}
    assert labels.parse_labels(lines.where("line_no IN (0, 6, 7)"), strict=True).count() == 1
    with pytest.raises(Exception, match="unreadable label line of image 1: x"):
        labels.parse_labels(lines.where("line_no < 6"), strict=True).collect()


def test_points_in_polygons(spark):
    from gridloom.functions.boxes import in_polygon

    star = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in star], px, py) for px, py in ((5.0, 1.0), (5.0, 5.0), (1.0, 5.0), (11.0, 1.0))], "poly array<struct<x:double,y:double>>, px double, py double")
    assert [r[0] for r in df.select(in_polygon(df["poly"], df["px"], df["py"])).collect()] == [True, False, True, False]


def test_hue_saturation_and_value(spark):
    from gridloom.operators import colors

    df = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0), (128, 128, 128), (255, 0, 128)], "r int, g int, b int")
    got = [tuple(r) for r in df.select(*(v.alias(n) for n, v in colors.hsv().items())).collect()]
    assert got == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 0), (0, 0, 128), (165, 255, 255)]


def test_exact_quantile_and_rank_within(spark):
    from gridloom.operators import splits

    rng = random.Random(1)
    values = [rng.choice([5, 5, 9000, rng.randrange(100_000)]) for _ in range(501)]
    df = spark.createDataFrame([(i, v, "ab"[i % 2]) for i, v in enumerate(values)], "image_id long, v long, bin string")
    for share in (0.0, 0.25, 0.3, 0.5, 1.0):
        assert splits.exact_quantile(df, "v", share).first()[0] == pytest.approx(df.selectExpr(f"percentile(v, {share})").first()[0])
    assert splits.exact_quantile(df.where("v < 0"), "v", 0.5).collect() in ([], [(None,)])
    ranked = splits.exact_rank(df, "v", ["image_id"], "nth", within=["bin"]).collect()
    want = {i: n for b in "ab" for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values) if "ab"[i % 2] == b), 1)}
    assert {r["image_id"]: r["nth"] for r in ranked} == want


def test_regions_with_missing_corners(spark):
    from gridloom.operators import tiling

    rois = spark.createDataFrame([(1, None, None, None, None), (2, None, 3, 9, 3), (3, 5, 5, 4, 9), (4, 7, None, None, 500), (5, 20, 2, 20, 8)], "image_id long, x0 long, y0 long, x1 long, y1 long")
    images = spark.createDataFrame([(i, 100, 50) for i in range(1, 6)], "image_id long, width long, height long")
    got = sorted(tuple(r) for r in tiling.manifest_boxes(rois, images).collect())
    assert got == [(1, 0, 0, 99, 49, True), (2, 0, 3, 9, 3, False), (4, 7, 0, 99, 49, False), (5, 20, 2, 20, 8, False)]


def test_suppression_at_several_values_gathers_boxes_once(spark):
    rng = random.Random(51)
    rows = [(i, d, *(lambda x, y, w: (x, y, x + w, y + w))(rng.randrange(60), rng.randrange(60), rng.randrange(1, 40)), rng.choice([0.2, 0.5, 0.5, rng.random()])) for i in range(9) for d in range(rng.choice([1, 3, 20, 70]))]
    dets = spark.createDataFrame(rows, "image_id long, det_id long, x1 long, y1 long, x2 long, y2 long, score double")
    once = stitch.nms_at(dets, [0.2, 0.5], "most", "clipped").select("most", "image_id", "det_id").collect()

    def share(a, b):
        w, h = (max(0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
        area = lambda t: (t[2] - t[0]) * (t[3] - t[1])
        return w * h / (area(a) + area(b) - w * h + 1e-9)

    want = set()
    for most in (0.2, 0.5):
        kept = []
        for r in sorted(rows, key=lambda r: (-r[6], r[1])):
            if all(k[0] != r[0] or share(k[2:6], r[2:6]) <= most for k in kept):
                kept.append(r)
        want |= {(most, r[0], r[1]) for r in kept}
    assert {tuple(r) for r in once} == want and len(once) == len(want)


def test_long_lists_go_alone(monkeypatch):
    import pyarrow as pa

    from gridloom.operators import folds

    rng = random.Random(52)
    lists = [[{"iou": 0.5, "det_id": rng.randrange(n), "box_id": rng.choice([None, rng.randrange(n)])} for _ in range(n)] for n in (0, 1, 5, 40, 40, 300)]
    pairs = pa.array([*lists, None], pa.list_(pa.struct([("iou", pa.float64()), ("det_id", pa.int64()), ("box_id", pa.int64())])))
    got = folds.unmatched_before(pairs).to_pylist()
    monkeypatch.setattr(folds, "ALONE", 4)
    assert folds.unmatched_before(pairs).to_pylist() == got
    for rows, out in zip(lists, got):
        want = []
        for r in rows:
            if not any(t["det_id"] == r["det_id"] or t["box_id"] is not None and t["box_id"] == r["box_id"] for t in want):
                want.append(r)
        assert out == want
