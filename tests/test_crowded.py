import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.functions.boxes import CLIPPED, INCLUSIVE
from gridloom.operators import crowded, stitch

KIND = "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double"


def boxes(seed, n, side, images=1, steps=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(side), rng.randrange(side)
        rows.append((rng.randrange(images), i, float(x), float(y), float(x + rng.randint(0, 90)), float(y + rng.randint(10, 90)), rng.randrange(steps) / steps))
    return rows


def told(df):
    return sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.select("image_id", "det_id", *stitch.CORNERS, "score").collect())


@pytest.mark.parametrize("mode", [INCLUSIVE, CLIPPED])
@pytest.mark.parametrize("most", [0.0, 0.3])
def test_suppression_equals_the_fold(spark, mode, most):
    df = spark.createDataFrame(boxes(1, 700, 900, 3), KIND).repartition(3)
    assert told(crowded.nms(df, most, mode, cell=64)) == told(stitch.nms(df, most, mode))


@pytest.mark.parametrize("name", ["merge_iou_avg", "merge_minmax"])
def test_clusters_equal_the_fold(spark, name):
    df = spark.createDataFrame(boxes(2, 600, 500, 3), KIND)
    assert told(getattr(crowded, name)(df, 0.25, cell=50)) == told(getattr(stitch, name)(df, 0.25))


def test_centre_clusters_equal_the_fold(spark):
    rows = boxes(3, 500, 600, 3) + [(9, 1, 0.0, 0.0, 0.0, 5.0, 0.5), (9, 2, 0.0, 0.0, 0.0, 5.0, 0.7)]  # an image whose median side is 0
    df = spark.createDataFrame(rows, KIND)
    for ratio in (0.3, 2.0):
        assert told(crowded.merge_center(df, ratio)) == told(stitch.merge_center(df, ratio))


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert told(crowded.nms(df, 0.5)) == [] == told(crowded.merge_iou_avg(df, 0.5)) == told(crowded.merge_center(df, 0.3))
    with pytest.raises(ValueError):
        crowded.nms(df, -0.1)


def plain_kept(rows, most, cell=100):
    grid, kept = defaultdict(list), []
    for _, i, x1, y1, x2, y2, s in sorted(rows, key=lambda r: (-r[6], r[1])):
        over = [(u, v) for u in range(int(x1 // cell), int((x2 + 1) // cell) + 1) for v in range(int(y1 // cell), int((y2 + 1) // cell) + 1)]

        def iou(o):
            w, h = min(x2, o[2]) - max(x1, o[0]) + 1, min(y2, o[3]) - max(y1, o[1]) + 1
            shared = max(w, 0) * max(h, 0)
            return shared / ((x2 - x1 + 1) * (y2 - y1 + 1) + (o[2] - o[0] + 1) * (o[3] - o[1] + 1) - shared + 1e-6)

        if not any(iou(o) > most for c in over for o in grid[c]):
            kept.append(i)
            for c in over:
                grid[c].append((x1, y1, x2, y2))
    return sorted(kept)


def test_one_image_of_a_hundred_thousand_boxes(spark):
    rows = boxes(4, 100_000, 12_000, steps=1000)
    df = spark.createDataFrame(rows, KIND).repartition(8)
    got = crowded.nms(df, 0.4, cell=256).select("det_id").collect()
    assert sorted(r.det_id for r in got) == plain_kept(rows, 0.4)
    assert crowded.merge_minmax(df, 0.4, cell=256).select(F.count("det_id")).first()[0] <= len(got) + 5000
