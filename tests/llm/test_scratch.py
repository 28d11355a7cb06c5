import re

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import scratch
from gridloom.llm.scratch import cut


def shuffle_files(spark):
    """The numbers of the shuffles whose files are still on this machine's disk."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {int(m[1]) for m in (re.search(r"shuffle_(\d+)_", files.apply(i).getName()) for i in range(files.size())) if m}


def test_shuffles_of_a_written_table_go_when_it_is_written(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = shuffle_files(spark), spark.conf.get(key)
    kept = cut(spark.range(2000).repartition(4, F.col("id") % 7).groupBy(F.col("id") % 5).count(), "sums")
    left = shuffle_files(spark) - before
    for _ in range(100):  # they are removed in the background
        if not left:
            break
        spark._jvm.Thread.sleep(100)
        left &= shuffle_files(spark)
    assert not left and spark.conf.get(key) == conf
    assert kept.agg(F.sum("count")).first()[0] == 2000


def test_tasks_get_texts_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key) if key in spark.conf.getAll else None
    spark.conf.unset(key)
    monkeypatch.setattr(scratch, "BATCH_BYTES", 1 << 16)
    try:
        texts = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), F.lit(5000)).alias("text"))
        sizes = scratch.cut(texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long"), "sizes")
        held = [r["n"] for r in sizes.collect()]
        assert sum(held) == 100 and max(held) <= 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
