"""Written tables that cut lineage, in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from the session; only where it is unset (a local test) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python tasks in batches of ``BATCH_BYTES``, unless the session says otherwise: by default 10,000 rows, which are
    tens of MB of text, are held at once by the executor and by its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Executions that begin within it delete their shuffle files when they end; else these stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs restart from the files, and its shuffles go at once."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with a column _copy; doc_id (null-safe) and _copy together tell documents apart.

    It is the hash of the text, so that different texts under one doc_id are documents of their own and repeated rows are one.
    Rows with a null doc_id are documents each; they are written with a number of their own.
    """
    nameless = cut(docs.where("doc_id IS NULL").withColumn("_copy", F.monotonically_increasing_id()), "nameless")
    return docs.where("doc_id IS NOT NULL").withColumn("_copy", F.xxhash64("text")).unionByName(nameless)
