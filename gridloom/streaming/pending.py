"""Pending label files as a stream: validated rows are appended once, and the checkpoint replaces a list of completed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators import labels
from gridloom.sources.files import lines_of


def pending_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (image_id, line_no, line) of the label files that arrive in a folder."""
    text = spark.readStream.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return lines_of(text.select(F.col("_metadata.file_name").alias("file"), "value"))


def ingest_stream(spark: SparkSession, folder: str, boxes_path: str, issues_path: str, checkpoint: str) -> StreamingQuery:
    """Append the boxes of lines that pass the detection checks, and the issues of the others, once for each file.

    A batch is written under its own number, so a batch that is run again replaces what it wrote before.
    """

    def batch(lines: DataFrame, number: int) -> None:
        issues = labels.validate_detection(lines)
        good = labels.parse_labels(lines).join(issues.select("image_id", "line_no").distinct(), ["image_id", "line_no"], "left_anti")
        good.drop("poly").write.mode("overwrite").parquet(f"{boxes_path}/batch={number}")
        issues.write.mode("overwrite").parquet(f"{issues_path}/batch={number}")

    return pending_lines(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
