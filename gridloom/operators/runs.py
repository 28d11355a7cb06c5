"""Experiment tables: grids, promotion and the winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def experiment_id(lr: Column, wd: Column, gain: Column) -> Column:
    """Text such as lr0p001_wd0p0003_cls1p0, from values given as text."""
    return F.replace(F.concat(F.lit("lr"), lr, F.lit("_wd"), wd, F.lit("_cls"), gain), F.lit("."), F.lit("p"))


def experiment_grid(spark: SparkSession, lrs: Sequence[str], wds: Sequence[str], gains: Sequence[str]) -> DataFrame:
    """Every combination, numbered in the order of nested loops; values are text, as they are written in an id."""
    def values(name, items):
        return spark.range(1).select(F.posexplode(F.array(*map(F.lit, items))).alias(f"{name}_at", name))

    grid = values("lr0", lrs).crossJoin(values("weight_decay", wds)).crossJoin(values("cls_gain", gains))  # literals
    number = (F.col("lr0_at") * len(wds) + F.col("weight_decay_at")) * len(gains) + F.col("cls_gain_at") + 1
    return grid.select(number.cast("long").alias("exp_num"), experiment_id(F.col("lr0"), F.col("weight_decay"), F.col("cls_gain")).alias("experiment_id"), *(F.col(c).cast("double").alias(c) for c in ("lr0", "weight_decay", "cls_gain")))


def progress(grid: DataFrame, runs: DataFrame) -> DataFrame:
    """The grid with the number of runs that each of its experiments has."""
    done = runs.groupBy("exp_num").agg(F.count(F.lit(1)).alias("runs"))
    return grid.join(done, "exp_num", "left").fillna(0, ["runs"])


def promote(runs: DataFrame, gain: float = 0.05, most: int = 3) -> DataFrame:
    """The best runs whose worst-bin recall beats the median by ``gain`` with at most the median of false positives.

    Order: worst-bin recall descending, false positives, number. If none qualifies the best of all; under three runs none.
    """
    base = runs.agg(F.median("worst_bin_recall").alias("_recall"), F.median("fp_per_image").alias("_fp"), F.count(F.lit(1)).alias("_runs"))
    judged = runs.crossJoin(F.broadcast(base)).where("_runs >= 3")  # one row
    judged = judged.withColumn("qualified", (F.col("worst_bin_recall") - F.col("_recall") >= gain) & (F.col("fp_per_image") <= F.col("_fp"))).drop("_recall", "_fp", "_runs")
    order = [F.desc("worst_bin_recall"), "fp_per_image", "exp_num"]
    best = judged.orderBy(F.desc("qualified"), *order).limit(most)
    # the unqualified stay only if no run qualified
    any_ok = F.max(F.col("qualified").cast("int")).over(Window.partitionBy(F.lit(1)))  # at most ``most`` rows
    return best.withColumn("_any", any_ok).where((F.col("_any") == 0) | F.col("qualified")).drop("_any")


def best_run(runs: DataFrame) -> DataFrame:
    """The run of phase B of the highest worst-bin recall; ties go to the smaller number."""
    return runs.where("phase = 'B'").orderBy(F.desc("worst_bin_recall"), "exp_num").limit(1)
