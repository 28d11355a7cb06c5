"""Pairing files with labels, new keys and unique names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.splits import exact_rank


def ingest(pending: DataFrame, files: DataFrame, completed: DataFrame, priority: Sequence[str] = ("jpg", "jpeg", "png")) -> DataFrame:
    """Rows (stem, ext, status): each pending label with its image by stem, the extension of the highest priority.

    Labels already completed are left out; those without an image are ``failed``.
    """
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("ext"))
    found = files.where(F.col("ext").isin(*priority)).groupBy("stem").agg(F.min_by("ext", order).alias("ext"))
    fresh = pending.select("stem").distinct().join(completed.select("stem"), "stem", "left_anti")
    return fresh.join(found, "stem", "left").withColumn("status", F.when(F.col("ext").isNull(), "failed").otherwise("ingested"))


def natural_key(name: str | Column) -> Column:
    """A text to sort names by as people do: runs of digits as numbers, all else without case.

    The name in lower case, with each run of digits written as a zero byte, how many digits its number has (four of them), and
    the number. A zero byte sorts before all others, so a name comes before those that go on with a letter, like the list of its
    runs. Equal keys are names that differ in case or leading zeros only. A null name gives null.
    """
    name = F.lower(F.col(name) if isinstance(name, str) else name)

    def run(r):
        digits = F.regexp_replace(r, "^0+(?=.)", "")
        return F.when(F.rlike(r, F.lit("^[0-9]")), F.concat(F.lit("\0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(r)

    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), run), "")


def parsed_name(name: str | Column) -> tuple[Column, Column, Column]:
    """Document, its first number and page of a name such as ``x12_3``: the page is the number after the last ``_``, if the name
    ends with it."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, r"_\d+$", ""), F.regexp_extract(name, r"^[^\d]*(\d+)", 1).try_cast("long"), F.regexp_extract(name, r"_(\d+)$", 1).try_cast("long")


def assign_keys(new: DataFrame, existing: DataFrame, prefix: str = "x") -> DataFrame:
    """Rows (name, new_name): documents numbered on after the largest existing number, in natural order; pages stay together.

    ``new`` and ``existing`` have a column ``name``. A document is a name without its page; names with many numbers or none are
    numbered like all others, and documents that differ in case or leading zeros by their names.
    """
    most = existing.agg(F.coalesce(F.max(parsed_name("name")[1]), F.lit(0)).alias("_most"))
    document, _, page = parsed_name("name")
    parsed = new.where("name IS NOT NULL").select("name", document.alias("document"), page.alias("page"))
    placed = exact_rank(parsed.select("document").distinct().withColumn("natural", natural_key("document")), "natural", ["document"], "nth")
    out = parsed.join(placed, "document").crossJoin(F.broadcast(most))  # one row
    return out.select("name", F.concat(F.lit(prefix), (F.col("_most") + F.col("nth")).cast("string"), F.when(F.col("page").isNotNull(), F.concat(F.lit("_"), F.col("page").cast("string"))).otherwise("")).alias("new_name"))


def unique_names(df: DataFrame, existing: DataFrame, order: Sequence[str]) -> DataFrame:
    """A free name for each row: the first row of a name keeps it unless it exists, the others get the next free suffix.

    Suffixes that existing names have already (``a_1``) are passed over.
    """
    from pyspark.sql import Window

    taken = existing.select(F.regexp_extract("name", r"^(.*?)(?:_(\d+))?$", 1).alias("name"), F.regexp_extract("name", r"^(.*?)(?:_(\d+))?$", 2).try_cast("int").alias("_k"))
    taken = taken.groupBy("name").agg(F.collect_set(F.coalesce("_k", F.lit(0))).alias("_taken"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    ranked = df.withColumn("_nth", nth).join(taken, "name", "left")
    none = F.coalesce("_taken", F.array().cast("array<int>"))
    free = F.element_at(F.array_except(F.sequence(F.lit(0), F.col("_nth") + F.size(none)), none), F.col("_nth"))
    return ranked.withColumn("new_name", F.when(free == 0, F.col("name")).otherwise(F.concat("name", F.lit("_"), free.cast("string")))).drop("_nth", "_taken")
