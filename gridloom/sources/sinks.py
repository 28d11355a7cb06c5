"""Writers of label text, issues, metrics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY = ("gt_set", "resolution", "total_gt", "matched_gt_0_4", "iou_threshold", "total_fp", "num_images")


def write_label_text(texts: DataFrame, folder: str) -> None:
    """One folder of text for each image (column ``text``), by image_id."""
    texts.select("image_id", "text").write.mode("overwrite").partitionBy("image_id").text(folder)


def append_summary(summary: DataFrame, folder: str) -> None:
    """Append summary rows as CSV, columns in a fixed order; those that are absent are empty."""
    columns = [F.col(c) if c in summary.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY]
    summary.select(*columns).write.mode("append").option("header", True).csv(folder)


def write_metrics(metrics: DataFrame, folder: str, kind: str = "json") -> None:
    writer = metrics.write.mode("overwrite")
    (writer.json if kind == "json" else writer.option("header", True).csv)(folder)


def nested_issues(issues: DataFrame) -> DataFrame:
    """One row for each file with its issues in order, for a JSON report."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "issue")))
    return issues.groupBy("image_id").agg(rows.alias("issues"))
