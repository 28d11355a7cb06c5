"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A ``Tree`` names shards, each in a rack of a region and with a weight. A row descends it: at each level every child draws
-ln(u) / weight, where u in (0, 1) is a hash of the row's key and the child's name alone, and the least draw wins. A child wins
in proportion to its weight. A change of one weight changes that child's draws only, so rows move out of it or into it and never
between two others: at each level movement is confined to the subtrees whose weights change.

``grown`` adds shards as a stage of their own. What a stage adds to a region draws beside that region at the first level, and a
row it wins goes down through the racks and shards of that stage. So one more shard takes rows, a share of its weight, from all
others alike and gives none of them to another shard, wherever in the tree it stands.

Slots number the rows of a shard from 0. Rows are range-partitioned by (shard, key, row), so a shard, and a key that repeats very
often, may spread over many tasks; a running sum over the rows that each partition holds of each shard joins their numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import cut

SHARDS = 40
#: Racks of a region and shards of a rack in ``even``.
RACKS, WIDE = 2, 4


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0
    stage: int = 0


@dataclass(frozen=True)
class Tree:
    leaves: tuple[Leaf, ...]

    def __post_init__(self):
        if not self.leaves or any(not leaf.weight > 0 for leaf in self.leaves):
            raise ValueError("a tree needs a shard, and each shard a weight above 0")
        if len({leaf.shard for leaf in self.leaves}) < len(self.leaves):
            raise ValueError("a shard stands at one place")

    def levels(self) -> tuple[list, list[list], list[list[list]]]:
        """The children to draw from: (stage, region)s, the racks of each, the shards of each rack, as (name, weight)."""
        tops: dict = {}
        for leaf in self.leaves:
            tops.setdefault((leaf.stage, leaf.region), {}).setdefault(leaf.rack, []).append(leaf)
        first, racks, shards = [], [], []
        for (stage, region), held in tops.items():
            first.append((f"region {stage} {region}", sum(leaf.weight for part in held.values() for leaf in part)))
            racks.append([(f"rack {stage} {region} {rack}", sum(leaf.weight for leaf in part)) for rack, part in held.items()])
            shards.append([[(f"shard {leaf.shard}", leaf.weight, leaf.shard) for leaf in part] for part in held.values()])
        return first, racks, shards


def even(shards: int, racks: int = RACKS, wide: int = WIDE) -> Tree:
    """Shards of equal weight, ``wide`` to a rack and ``racks`` to a region."""
    return Tree(tuple(Leaf(n, n // (racks * wide), n // wide % racks) for n in range(shards)))


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in the lightest rack of the lightest region."""
    regions: dict = {}
    for leaf in tree.leaves:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf.weight)
    region = min(regions, key=lambda r: (sum(map(sum, regions[r].values())), r))
    rack = min(regions[region], key=lambda r: (sum(regions[region][r]), r))
    number, stage = max(leaf.shard for leaf in tree.leaves) + 1, max(leaf.stage for leaf in tree.leaves) + 1
    return Tree((*tree.leaves, Leaf(number, region, rack, weight, stage)))


def _draw(key: Column, name: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, name), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.ln(u) / weight


def _won(key: Column, children: Column) -> Column:
    """The position of the child (name, weight) with the least draw; the first of equal draws."""
    drawn = F.transform(children, lambda c, i: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), i.alias("at")))
    return F.array_min(drawn)["at"]


def _children(rows: list[tuple]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")) for name, weight, *_ in rows))


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key, a text or a value cast to one; a null is a key of its own.

    Only the key and the tree decide. The three levels are literals of as many entries as the tree has nodes.
    """
    first, racks, shards = tree.levels()
    text = F.coalesce(key.cast("string"), F.lit("\0null"))

    def down(at):  # (position among the regions) -> (region, rack)
        return F.struct(at["region"].alias("region"), _won(at["key"], F.get(F.array(*map(_children, racks)), at["region"])).alias("rack"), at["key"].alias("key"))

    def leaf(at):
        return F.struct(at["region"], at["rack"], _won(at["key"], F.get(F.get(F.array(*(F.array(*map(_children, part)) for part in shards)), at["region"]), at["rack"])).alias("shard"))

    numbers = F.array(*(F.array(*(F.array(*(F.lit(n) for _, _, n in rack)) for rack in part)) for part in shards))
    # each step is the element of an array of one, so that it is computed once
    start = F.array(F.struct(_won(text, _children(first)).alias("region"), text.alias("key")))
    ends = F.transform(F.transform(F.transform(start, down), leaf), lambda at: F.get(F.get(F.get(numbers, at["region"]), at["rack"]), at["shard"]))
    return F.get(ends, F.lit(0))


def sharded(docs: DataFrame, tree: Tree) -> DataFrame:
    """``docs`` with the columns shard and grown_shard (with one more shard). Any key, row or column passes through."""
    key = F.col("doc_id")
    return docs.withColumns({"shard": place(key, tree), "grown_shard": place(key, grown(tree))})


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with slot: the place of a row in its shard by ``order``, from 0 without gaps. A written table.

    ``rows`` is a written table. Rows that ``order`` cannot tell apart are numbered in any order.
    """
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("shard", *order, "_row").sortWithinPartitions("shard", *order, "_row")
    at = cut(ranged.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ranged")  # partition, then row within it
    part = F.shiftright("_at", 33)
    held = at.groupBy(part.alias("_part"), "shard").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("_part", "shard", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_before"))
    # one row for each partition and shard in it: at most partitions + shards
    return at.withColumn("_part", part).join(F.broadcast(before), ["_part", "shard"]).withColumn("slot", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def assignment(docs: DataFrame, tree: Tree) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of ``docs``.

    size is the text's UTF-8 bytes plus 16; a null text has none, and the checksum 0, like an empty one. Rows of one doc_id, and
    all rows with a null one, share a shard. slot follows the order of a hash of doc_id, then doc_id, size and checksum. Other
    columns are not read; an empty table gives no rows. Each text is read once and never shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = cut(sharded(sized, tree).withColumn("_hash", F.xxhash64("doc_id")), "sized")
    return slots(rows, ["_hash", "doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, folder: str, per_file: int = 1_000_000) -> None:
    """Write ``docs`` as Parquet, a folder shard=N for each shard that has rows; a file holds at most ``per_file`` rows.

    Rows are dealt by shard and a salt of the text, so a large shard is written by several tasks.
    """
    salt = F.pmod(F.xxhash64("text"), F.lit(16))
    out = docs.withColumn("shard", place(F.col("doc_id"), tree)).repartition("shard", salt)
    out.write.option("maxRecordsPerFile", per_file).partitionBy("shard").parquet(folder)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), even(SHARDS))


QUERIES = {"op13_shards": op13_shards}
ORACLE_SQL: dict[str, str] = {}
