import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import keys, ranks, splits, stitch


def test_ranks_of_one_hot_key_and_of_hashes(spark):
    df = spark.range(0, 5000, 1, 6).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id")).alias("k"), (F.col("id") % 4).alias("g"))
    rows = df.collect()
    want = {r.id: n for n, r in enumerate(sorted(rows, key=lambda r: (r.k, r.id)), 1)}
    assert {r.id: r["rank"] for r in splits.exact_rank(df, "k", ["id"]).collect()} == want
    want = {r.id: n for g in range(4) for n, r in enumerate(sorted((r for r in rows if r.g == g), key=lambda r: (-r.k, r.id)), 1)}
    assert {r.id: r.nth for r in ranks.ranked(df, [F.desc("k"), F.col("id")], "nth", ["g"]).collect()} == want
    assert splits.exact_rank(df.limit(0), "k", ["id"]).collect() == []


def test_no_window_sees_more_rows_than_partitions(spark):
    """The only windows over a whole group work on the counts by partition."""
    df = spark.range(0, 1000, 1, 4).withColumn("k", F.col("id") * 37 % 101)
    plan = ranks.ranked(df, ["k", "id"])._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "Aggregate [_part" in window.split("\n+- ")[0]


def test_running_sums(spark):
    df = spark.range(0, 900, 1, 5).select("id", (F.col("id") * 7 % 13).alias("v"), (F.col("id") % 2).alias("g"))
    want, sums = {}, {0: 0, 1: 0}
    for r in sorted(df.collect(), key=lambda r: (r.v, r.id)):
        want[r.id] = sums[r.g]
        sums[r.g] += r.v
    assert {r.id: r.before for r in ranks.running(df, ["v", "id"], "v", "before", ["g"]).collect()} == want


@pytest.mark.parametrize("parts", [1, 16])
def test_islands_equal_the_windows(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(1)
        df = spark.createDataFrame([(rng.choice([1, 1, 1, 2]), i, float(rng.randrange(9000))) for i in range(3000)], "image_id long, box_id long, v double")
        a = stitch.cluster_1d(df, F.col("v"), 4, ["image_id"], "box_id")
        b = ranks.islands(df, F.col("v"), 4, ["image_id"], "box_id")
        assert sorted(map(tuple, a.select("image_id", "box_id", "cluster").collect())) == sorted(map(tuple, b.select("image_id", "box_id", "cluster").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_islands_of_one_image_of_a_million_boxes(spark):
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("image_id"), "id", (F.col("id") * 7919 % 1_000_003 * 2 + F.when(F.col("id") * 7919 % 1_000_003 >= 500_000, 100).otherwise(0)).cast("double").alias("v"))
    got = ranks.islands(df, F.col("v"), 5, ["image_id"], "id")
    a = got.groupBy("cluster").agg(F.count("*").alias("n"), F.min("v").alias("low")).orderBy("cluster").collect()
    b = stitch.cluster_1d(df, F.col("v"), 5, ["image_id"], "id").groupBy("cluster").agg(F.count("*").alias("n"), F.min("v").alias("low")).orderBy("cluster").collect()
    assert a == b and len(a) == 2


def plain_key(text):
    return [int(c) if c.isdigit() else c.lower() for c in re.split("([0-9]+)", text)]


def test_natural_order(spark):
    names = ["x2_1", "x10_1", "X1_10", "x1_9", "plan", "Plan", "plan2", "plan02", "plan2a10", "plan2a9", "7", "70a", "07", "", "a-1-2-3", "a-1-2-10", "a--", "z" + "9" * 40, "z" + "8" * 40, "z" + "1" * 41]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in df.orderBy(keys.natural_key("name"), "name").collect()]
    assert got == sorted(names, key=lambda n: (plain_key(n), n))


def test_no_name_is_dropped(spark):
    new = spark.createDataFrame([(n,) for n in ("cover", "p10_2", "p10_1", "p9_1", "P9_1", "a1b2", "a1b10", None)], "name string")
    old = spark.createDataFrame([("x41_3",), ("none",)], "name string")
    got = {r["name"]: r["new_name"] for r in keys.assign_keys(new, old).collect()}
    assert got == {"a1b2": "x42", "a1b10": "x43", "cover": "x44", "P9_1": "x45_1", "p9_1": "x46_1", "p10_1": "x47_1", "p10_2": "x47_2"}
