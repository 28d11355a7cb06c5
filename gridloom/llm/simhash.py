"""SimHash near-duplicates: segment bit counts as an embedding, a grid range join under Manhattan distance, an exact test.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment is mapped to its bit count. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so a range join of radius 3 on the
vectors loses no link. The vector is kept packed: with the bits of a segment sorted ("01" and "10" alike), the Manhattan
distance is the Hamming distance of two packed vectors.

The grid of the range join: the 32 coordinates form six groups. Vectors within distance 3 differ in at most three of the
groups, so they share at least one of the 20 cells that are given by three groups. A cell of up to ``CELL`` distinct
fingerprints is searched within one task. The fingerprints of larger cells go to a second grid, which fixes 13 of the 16
nibbles of the fingerprint itself: its cells hold at most 4,096 distinct fingerprints by construction, and a link of three
bits touches at most three nibbles, so no link is lost there either. Within a cell a spanning forest of the exact links is
returned, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.scratch import cut, told_apart

RADIUS = 3
#: Distinct fingerprints that one cell may hold; the second grid keeps this bound by construction (3 free nibbles).
CELL = 4096
#: Bits of each of the six groups of coordinates.
GROUP_BITS = (12, 12, 10, 10, 10, 10)
BLOCK = 65536


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _group_masks() -> list[int]:
    """Masks that keep three of the six groups of coordinates."""
    groups, at = [], 0
    for n in GROUP_BITS:
        groups.append(((1 << n) - 1) << at)
        at += n
    return [_signed(a | b | c) for a, b, c in combinations(groups, 3)]


def _nibble_masks() -> list[int]:
    """Masks that free three of the sixteen nibbles."""
    full = (1 << 64) - 1
    return [_signed(full ^ sum(15 << (4 * i) for i in free)) for free in combinations(range(16), 3)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text over word shingles; null and empty texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    digest, n = xxhash.xxh64_intdigest, len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        h = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def sorted_segments(f: np.ndarray) -> np.ndarray:
    """The packed vector of the bit counts of two-bit segments (each segment's bits sorted)."""
    low = np.uint64(0x5555555555555555)
    one = np.uint64(1)
    a, b = f & low, (f >> one) & low
    return (a | b) | ((a & b) << one)


def spanning_links(f: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the pairs of ``f`` that differ in at most ``radius`` bits."""
    counts, links = sorted_segments(f), []
    left = np.arange(len(f))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = np.bitwise_count(counts[left] ^ counts[i]) <= radius  # the Manhattan lower bound
            if near.any():
                at = np.flatnonzero(near)
                at = at[np.bitwise_count(f[left[at]] ^ f[i]) <= radius]
                if len(at):
                    found = left[at]
                    links += [(i, j) for j in found]
                    front += list(found)
                    left = np.delete(left, at)
    return links


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (doc_id, fp), with _copy if ``docs`` has it; fp is the fingerprint's 64 bits as a signed long."""
    names = [c for c in ("doc_id", "_copy") if c in docs.columns]

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(t.as_py(), width) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(f, pa.int64())], [*names, "fp"])

    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, fp long")


def _links_of(cells: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            out = []
            for fps in frame["fps"]:
                f = np.unique(np.asarray(fps, np.int64).view(np.uint64))
                s = f.view(np.int64)
                out += [(s[i], s[j]) for i, j in spanning_links(f)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return cells.select("fps").mapInPandas(run, "a long, b long")


def _celled(fps: DataFrame, value, masks: list[int]) -> DataFrame:
    """Rows (cell, key, fp): one for each mask."""
    return fps.select("fp", value.alias("value"), F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("cell", "mask")).select("cell", F.col("value").bitwiseAND(F.col("mask")).alias("key"), "fp")


def hamming_links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Rows (a, b): links that join the same fingerprints as all pairs within three bits. ``fps``: distinct, in column fp."""
    low = F.lit(0x5555555555555555)
    a, b = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    packed = a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    grid = _celled(fps, packed, _group_masks())
    sizes = grid.groupBy("cell", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = grid.join(sizes, ["cell", "key"])
    small = shared.where(F.col("n") <= cell).groupBy("cell", "key").agg(F.collect_list("fp").alias("fps"))
    crowded = shared.where(F.col("n") > cell).select("fp").distinct()
    fine = _celled(crowded, F.col("fp"), _nibble_masks()).groupBy("cell", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return _links_of(small.unionByName(fine)).distinct()


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): one for each row of ``docs``.

    Null texts count as empty; empty texts have fingerprint zero and are linked like any other. A row whose doc_id is null
    stays; component_id is the smallest doc_id that is not null in its group, or null. Repeated rows are each returned.
    Other columns of ``docs`` are not read.
    """
    prints = cut(fingerprints(docs, width), "prints")
    labelled = _labelled(prints)
    least = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = labelled.join(least, "comp").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(prints: DataFrame) -> DataFrame:
    """Rows (fp, least, comp): each distinct fingerprint, its smallest doc_id and its component."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    comp = components(hamming_links(distinct.select("fp")), "a", "b")
    return distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id, null after all others.

    Rows with a null doc_id and different texts under one doc_id are told apart; of repeated rows that stay one is left. Other
    columns, of whatever name, are passed on.
    """
    told = told_apart(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    prints = cut(fingerprints(told, width), "prints")
    grouped = cut(prints.join(_labelled(prints).select("fp", "comp"), "fp").groupBy("comp", "doc_id", "_copy").agg(F.count(F.lit(1)).alias("n")), "grouped")
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_copy")
    first = grouped.groupBy("comp").agg(F.min(own).alias("first"))
    judged = grouped.join(first, "comp").select(F.col("doc_id").alias("_doc"), F.col("_copy").alias("_same"), "n", own.eqNullSafe(F.col("first")).alias("kept"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_copy") == F.col("_same"))
    stay = told.join(judged.where("NOT kept OR n > 1"), same, "left_anti")
    repeated = told.join(judged.where("kept AND n > 1"), same, "left_semi").dropDuplicates(["doc_id", "_copy"])
    return stay.unionByName(repeated).select(*(F.col("row")[c].alias(c) for c in docs.columns))


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
