"""Links between near-duplicate texts from MinHash signatures, and from rare shingles where signatures do not tell texts apart.

A signature (key, m0, m1, ...) holds minima of 21 bits, three to a long. ``bands`` name the minima that make a bucket each; texts
that share a bucket are candidates. Every candidate pair is either compared, or has been joined already through others, or is
ruled out by a bound; none is dropped because many share its bucket.

1. Where at most ``SMALL`` texts share a bucket, all of them are compared. In larger buckets every member is compared with the
   smallest key, the leader.
2. The links found are joined into components. Small buckets, and large ones that hold one component, are settled.
3. In other buckets of at most ``MIDDLE`` texts all pairs of different components are compared.
4. In the largest lie texts that share most of their shingles with many others, such as the rows of a form. Their shingles are
   counted among themselves and each text is filed under its rarest ones, by a prefix filter: of a pair of similarity s, the
   text of n shingles that is not the longer one holds a shared shingle among its n - ceil(2s / (1 + s) n) + 1 rarest, the other
   one among its n - ceil(s n) + 1 rarest. Where at most ``MIDDLE`` texts share such a shingle, all pairs of different components are compared.
5. The texts of larger groups are dealt to blocks, and the pairs of blocks that share a group to the tasks; a pair of blocks is
   compared at once, by a product of its tables of texts and shingles. A large component has blocks of its own, which are not
   compared with each other. So one large family costs no more than a few passes, and only texts that share rare shingles with
   very many strangers are compared with all of them.

Before texts are fetched in steps 1, 3 and 4, their minima are compared: a pair of the wanted similarity s that met in a band of r
rows agrees in r minima and in a share s of the others. Pairs with so few equal minima that this happens less than once in ``RARE``
are passed over; the similarity of the others is computed exactly, from the sets of their shingles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.scratch import cut, drop

Texts = Callable[[DataFrame], DataFrame]
Alike = Callable[[DataFrame], DataFrame]

#: Rows of a counted table that may be broadcast (two longs each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Texts of a bucket that are all compared at once, and of a bucket or under a rare shingle that are compared pair by pair.
SMALL, MIDDLE = 16, 256
#: Texts of larger groups that are compared as a block, their shingles, and shingles of a pair of blocks that are counted at once.
BLOCK, HELD, WIDE = 1024, 1 << 20, 2048
#: Pairs that a task gathers before it makes rows of them.
PAIRS = 1 << 20
RARE = 100_000
FIELD = 21
#: Bits of each minimum that are compared before texts are fetched: equal minima have equal bits, others once in 128 times.
PART = 7
_odd = np.uint64(0x9E3779B97F4A7C15)


def jaccard(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two sets given as arrays; each array expression is evaluated once."""
    counted = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: F.struct(F.size(F.array_intersect(p["a"], p["b"])).alias("both"), (F.size(p["a"]) + F.size(p["b"])).alias("n")))
    return F.get(F.transform(counted, lambda c: c["both"] / (c["n"] - c["both"])), F.lit(0))


def minimum(i: int, side: str = "") -> Column:
    return F.shiftrightunsigned(f"{side}m{i // 3}", FIELD * (i % 3)).bitwiseAND(F.lit((1 << FIELD) - 1))


def sketched(signed: DataFrame, count: int) -> DataFrame:
    """Rows (key, s0, s1, ...) with the lowest ``PART`` bits of each of the minima, nine to a long: a third of a signature."""
    each = 63 // PART
    words = [[F.shiftleft(minimum(i).bitwiseAND(F.lit((1 << PART) - 1)), PART * (i % each)) for i in range(at, min(count, at + each))] for at in range(0, count, each)]
    return signed.select("key", *(reduce(Column.bitwiseOR, w).alias(f"s{n}") for n, w in enumerate(words)))


def affine_bands(order: int, classes: int) -> list[list[int]]:
    """Lines of an affine plane of prime order: ``order`` x ``classes`` bands over ``order`` squared minima; two share one at most."""
    return [[x * order + (slope * x + at) % order for x in range(order)] for slope in range(classes) for at in range(order)]


def bucketed(signed: DataFrame, bands: list[list[int]]) -> DataFrame:
    """Rows (key, bucket), one for each band of a signature. As one expression the bands make a method that the JVM leaves uncompiled."""
    words = [c for c in signed.columns if c != "key"]

    def run(batches):
        for batch in batches:
            held = [batch[w].to_numpy().view(np.uint64) for w in words]
            minima = [held[i // 3] >> np.uint64(FIELD * (i % 3)) & np.uint64((1 << FIELD) - 1) for i in range(3 * len(words))]
            for n, band in enumerate(bands):
                x = np.full(batch.num_rows, n + 1, np.uint64)
                for i in band:
                    x = (x * _odd) ^ minima[i]
                    x = (x ^ (x >> np.uint64(32))) * _odd
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array((x ^ (x >> np.uint64(29))).view(np.int64))], ["key", "bucket"])

    return signed.mapInArrow(run, "key long, bucket long")


def few(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``BROADCAST_ROWS`` rows; it should be a written table."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def fewest_equal(total: int, rows: int, least: float) -> int:
    """The number of equal minima that a pair of similarity ``least``, equal in a band of ``rows``, falls under once in ``RARE`` times."""
    free, chance = total - rows, 0.0
    for n in range(free + 1):
        chance += comb(free, n) * least**n * (1 - least) ** (free - n)
        if chance > 1 / RARE:
            return rows + n
    return total


def _equal(count: int, a: str, b: str) -> Column:
    """How many of the minima of two sketches are equal in their ``PART`` bits: no fewer than are equal."""
    each, mask = 63 // PART, F.lit((1 << PART) - 1)
    part = lambda i, side: F.shiftrightunsigned(f"{side}s{i // each}", PART * (i % each)).bitwiseAND(mask)
    return reduce(Column.__add__, ((part(i, a) == part(i, b)).cast("int") for i in range(count)))


def _runs(batches, columns: list[str]):
    """Tables of whole groups, from batches in the order of their first column; a group must fit a task."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(columns)
        held = table if held is None else pa.concat_tables([held, table])
        first = held[0].to_numpy()
        at = int(np.searchsorted(first, first[-1])) if len(first) else 0
        if at:
            yield held.slice(0, at)
            held = held.slice(at).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _bounds(first: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(first))


def _met(batches):
    """Pairs (a, b) of the texts that share a bucket, from rows (bucket, key) in order: all pairs of small buckets, without the
    bucket; of a larger one each member b with the smallest key a. Of a large bucket no more than a batch is held."""
    leader = None  # of a large bucket that has begun: (bucket, key)
    bucket, key = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(last: bool):
        nonlocal leader, bucket, key
        if not len(bucket):
            return
        at = _bounds(bucket)
        n = np.diff(at)
        large = n > SMALL
        lead = key[at[:-1]].copy()
        if leader is not None and leader[0] == bucket[0]:
            large[0], lead[0] = True, leader[1]
        stay = 0 if last or large[-1] else n[-1]
        if large[-1]:
            leader = bucket[-1], lead[-1]
        rows = np.repeat(large, n)
        if rows.any():
            yield np.repeat(lead, n)[rows], key[rows], bucket[rows]
        rows = ~rows & np.repeat(n > 1, n)
        rows[len(rows) - stay :] = False
        some, held = bucket[rows], key[rows]
        for d in range(1, min(SMALL, len(some))):
            both = some[d:] == some[:-d]
            if not both.any():
                break
            yield held[:-d][both], held[d:][both], None
        bucket, key = bucket[len(bucket) - stay :], key[len(key) - stay :]

    def arrow(found):
        for a, b, of in found:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if of is None else pa.array(of)], ["a", "b", "bucket"])

    for batch in batches:
        bucket, key = np.append(bucket, batch["bucket"].to_numpy()), np.append(key, batch["key"].to_numpy())
        yield from arrow(out(False))
    yield from arrow(out(True))


def likely(pairs: DataFrame, signed: DataFrame, count: int, fewest: int) -> DataFrame:
    """The distinct pairs (a, b) with ``fewest`` equal minima or more; a written table."""
    pairs = cut(pairs.select("a", "b").distinct(), "pairs")
    keys = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    drawn = cut(sketched(signed.join(few(keys), "key", "left_semi"), count), "sketches")
    words = [c for c in drawn.columns if c != "key"]
    met = pairs
    for side in "ab":
        met = met.join(drawn.select(F.col("key").alias(side), *(F.col(w).alias(f"{side}_{w}") for w in words)), side)
    out = cut(met.where(_equal(count, "a_", "b_") >= fewest).select("a", "b"), "likely")
    for table in (pairs, keys, drawn):
        drop(table)
    return out


def _of_like_sizes(pairs: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets can have a similarity of ``least`` by their ``sizes`` (key, size); a written table."""
    for side in "ab":
        pairs = pairs.join(few(sizes.select(F.col("key").alias(side), F.col("size").alias(f"{side}_size"))), side)
    low, high = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    return cut(pairs.where(low >= F.lit(least) * high - 1e-6).select("a", "b"), "like")


def verified(pairs: DataFrame, found: DataFrame, alike: Alike, least: float, size: Column | None = None) -> DataFrame:
    """The pairs (a, b) that ``alike`` keeps by their texts in ``found``; a written table. ``size`` is the number of a text's
    shingles, where it can be told without cutting it. Texts of no pair that is left take no part in the joins."""
    tables = [pairs]
    if size is not None:
        tables.append(cut(found.select("key", size.alias("size")), "sizes"))
        tables.append(pairs := _of_like_sizes(pairs, tables[-1], least))
    keys = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    found = cut(found.join(few(keys), "key", "left_semi"), "held")
    left, right = found.select(F.col("key").alias("a"), F.col("text").alias("left")), found.select(F.col("key").alias("b"), F.col("text").alias("right"))
    out = cut(alike(pairs.join(left, "a").join(right, "b")).select("a", "b"), "links")
    for table in (*tables, keys, found):
        drop(table)
    return out


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.select(F.col("node").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def _mixed(rows: DataFrame, group: str, also: Column | None = None) -> DataFrame:
    """The rows of groups of two components or more for which ``also`` holds of a row, with the number n of a group's rows. ``rows``: (group, key, comp, ...), a written table."""
    held = F.lit(True) if also is None else F.max(also)
    sizes = rows.groupBy(group).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"), held.alias("held")).where("low != high AND held")
    return with_hot(rows, cut(sizes.select(group, "n"), "mixed"), group)


def _likely_within(rows: DataFrame, drawn: DataFrame, count: int, fewest: int, least: float) -> DataFrame:
    """The distinct pairs (a, b) of different components with ``fewest`` equal minima or more in groups of at most ``MIDDLE`` texts.

    ``rows``: (group, key, comp, size, filed); ``drawn``: the texts ``sketched``. Of a pair, the text that is not the longer one must
    be filed, and sizes must allow ``least``.
    """
    words, each = [c for c in drawn.columns if c != "key"], 63 // PART
    columns = ["group", "key", "comp", "size", "filed", *words]

    def lists(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """A row for each a, with its different b."""
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        a, b = a[new], b[new]
        at = _bounds(a)
        return pa.RecordBatch.from_arrays([pa.array(a[at[:-1]]), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(b))], ["a", "b"])

    def run(batches):
        pairs, size = [], 0
        for a, b in met_within(batches):
            pairs.append((np.minimum(a, b), np.maximum(a, b)))
            size += len(a)
            if size >= PAIRS:
                yield lists(pairs)
                pairs, size = [], 0
        if size:
            yield lists(pairs)

    def met_within(batches):
        for table in _runs(batches, columns):
            group, key, comp, size, filed, *held = (table[c].to_numpy() for c in columns)
            held = [w.view(np.uint64) for w in held]
            minima = [((held[i // each] >> np.uint64(PART * (i % each))) & np.uint64((1 << PART) - 1)).astype(np.uint8) for i in range(count)]
            at = _bounds(group)
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                k, c, n, f = (x[low:high] for x in (key, comp, size, filed))
                ok = (f & (n <= n[:, None])).T  # from a filed text to one not shorter
                ok &= (c[:, None] != c) & (n[:, None] >= least * n - 1e-6)
                if not ok.any():
                    continue
                equal = np.zeros(ok.shape, np.uint8)
                for m in minima:
                    m = m[low:high]
                    equal += m[:, None] == m
                a, b = np.nonzero(ok & (equal >= fewest))
                if len(a):
                    yield k[a], k[b]

    met = rows.join(drawn, "key").select(*columns)
    # texts meet in many groups: what a task finds for a text is one row, and pairs are rows only when they differ
    found = met.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b array<long>")
    return found.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("b"))).alias("b")).select("a", F.explode("b").alias("b"))


def rare_shingles(rows: DataFrame, least: float) -> DataFrame:
    """Rows (shingle, key, size, filed): the rarest of the shingles of each text that two or more texts hold. A written table.

    ``rows``: a written table (key, shingle) of different pairs; size is a text's number of shingles. Two texts of a similarity of
    ``least`` or more share one of these rows' shingles, under which the one that is not the longer is filed.
    """
    counts = cut(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    shared = with_hot(rows, counts, "shingle").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    ranked = shared.join(rows.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("size")), "key")

    def room(share: float) -> Column:
        """A little room, so that rounding keeps no shingle out. Those that no other text holds are the rarest."""
        return F.col("size") - F.ceil(F.col("size") * F.lit(share) - 1e-6).cast("int") + 1 - (F.col("size") - F.size("held"))

    most = ranked.where(room(least) > 0).select("key", "size", room(2 * least / (1 + least)).alias("first"), F.posexplode(F.slice("held", F.lit(1), room(least))).alias("at", "r"))
    out = cut(most.select("r.shingle", "key", "size", (F.col("at") < F.col("first")).alias("filed")), "rare")
    drop(counts)
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (shingle, key, comp, filed, block, pure): each text with the block that it is in, of texts whose most common shingle is
    the same; pure is the component of a block that holds no other. ``rows``: (shingle, key, comp, size, filed, n), a written table."""
    homes = cut(rows.groupBy("key").agg(F.max_by("shingle", F.struct("n", "shingle")).alias("home"), F.any_value("comp").alias("comp"), F.any_value("size").alias("size")), "homes")
    own = homes.groupBy("home", "comp").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("held"))
    # a component that fills a block has blocks of its own
    own = own.withColumn("pure", F.when(F.col("texts") >= BLOCK // 4, F.col("comp")))
    parts = own.groupBy("home", "pure").agg(F.sum("texts").alias("texts"), F.sum("held").alias("held"))
    parts = parts.withColumn("parts", F.ceil(F.greatest(F.col("texts") / BLOCK, F.col("held") / HELD)))
    own = own.select("home", "comp", "pure").join(parts.select("home", "pure", "parts").withColumnsRenamed({"home": "at", "pure": "of"}), (F.col("home") == F.col("at")) & F.col("pure").eqNullSafe(F.col("of")))
    held = homes.join(own.select("home", "comp", "pure", "parts"), ["home", "comp"])
    block = F.xxhash64("home", F.coalesce("pure", F.lit(0)), F.col("pure").isNull(), F.pmod(F.xxhash64("key"), F.col("parts")))
    placed = cut(held.select("key", block.alias("block"), "pure"), "placed")
    out = cut(rows.select("shingle", "key", "comp", "filed").join(placed, "key"), "blocks")
    drop(homes)
    drop(placed)
    return out


def _links_within(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that join the linked texts of large groups, from all their pairs. ``rows``: (shingle, key, comp, size, filed, n), a
    written table; ``sets``: (key, held), the shingles of each text. A text is sent to a block once, whatever shingles they share."""
    rows = _blocks(rows)
    groups = cut(rows.groupBy("shingle", "block").agg(F.max("filed").alias("filed"), F.any_value("pure").alias("pure")), "groups")
    left, right = (groups.select("shingle", F.col("block").alias(s), F.col("pure").alias(f"{s}_pure"), "filed") for s in "lr")
    met = left.where("filed").drop("filed").join(right.drop("filed"), "shingle").where("l_pure IS NULL OR r_pure IS NULL OR l_pure != r_pure")
    met = cut(met.select("shingle", "l", "r"), "met")
    left = rows.where("filed").join(met, (rows["shingle"] == met["shingle"]) & (F.col("block") == F.col("l"))).select("key", "comp", "l", "r").distinct()
    right = rows.join(met, (rows["shingle"] == met["shingle"]) & (F.col("block") == F.col("r"))).select("key", "comp", "l", "r").distinct()
    left, right = (df.withColumn("left", F.lit(at)) for df, at in ((left, True), (right, False)))

    def run(table: pa.Table) -> pa.Table:
        key, comp, side = (table[c].to_numpy() for c in ("key", "comp", "left"))
        held = table["held"].combine_chunks()
        sizes = np.diff(held.offsets.to_numpy())
        values, of = held.flatten().to_numpy(), np.repeat(np.arange(len(key)), sizes)
        place = np.cumsum(side) - 1
        place[~side] = np.cumsum(~side)[~side] - 1
        own = side[of]
        common = np.intersect1d(values[own], values[~own])
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        hit = common[at] == values if len(common) else np.zeros(len(values), bool)
        at, of = at[hit], of[hit]
        order = np.argsort(at, kind="stable")
        at, of = at[order], of[order]
        both = np.zeros((int(side.sum()), int((~side).sum())), np.float32)
        for begin in range(0, len(common), WIDE):
            part = slice(*np.searchsorted(at, [begin, begin + WIDE]))
            x, y = (np.zeros((n, WIDE), np.float32) for n in both.shape)
            l = side[of[part]]
            x[place[of[part]][l], at[part][l] - begin] = 1
            y[place[of[part]][~l], at[part][~l] - begin] = 1
            both += x @ y.T
        a, b = np.nonzero((both > 0) & (comp[side][:, None] != comp[~side]))
        met = both[a, b].astype(np.int64)
        good = met / (sizes[side][a] + sizes[~side][b] - met) >= least
        a, b = key[side][a[good]], key[~side][b[good]]
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = ends[: len(a)], ends[len(a) :]
        root, before = np.arange(len(nodes)), None
        while before is None or (root != before).any():  # each linked text with the smallest that it reaches here
            before, low = root.copy(), np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
        moved = root != np.arange(len(nodes))
        return pa.table({"a": pa.array(nodes[root[moved]], pa.int64()), "b": pa.array(nodes[moved], pa.int64())})

    cells = left.unionByName(right).join(sets, "key")
    return cut(cells.groupBy("l", "r").applyInArrow(run, "a long, b long").distinct(), "links")


def near_components(signed: DataFrame, bands: list[list[int]], texts: Texts, alike: Alike, shingled: Texts, least: float, size: Column | None = None) -> DataFrame:
    """Rows (node, comp) of the texts that have a link, a similarity of ``least`` or more; comp is the smallest key joined.

    ``signed`` is a written table of signatures, one for each key, ``texts`` gives one (key, text) for each key of a written
    table, ``alike`` those of the rows (a, b, left, right) whose texts have the exact similarity, ``shingled`` the different rows
    (key, shingle) of a table (key, text), ``size`` their number for a text, if that is a column.
    """
    count, width = 1 + max(i for b in bands for i in b), max(map(len, bands))
    fewest = fewest_equal(count, width, least)
    met = cut(bucketed(signed, bands).repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_met, "a long, b long, bucket long"), "met")
    near = likely(met.where("a != b"), signed, count, fewest)
    members = met.where("bucket IS NOT NULL").select(F.col("bucket").alias("group"), F.col("b").alias("key"))
    keys = cut(near.select(F.explode(F.array("a", "b")).alias("key")).unionByName(members.select("key")).distinct(), "keys")
    found = cut(texts(keys), "texts")
    links = verified(near, found, alike, least, size)
    comp = cut(components(links, "a", "b"), "comp")
    mixed = cut(_mixed(cut(_labelled(members, comp), "labelled"), "group"), "mixed")
    for table in (met, keys):
        drop(table)
    if mixed.isEmpty():
        drop(found)
        return comp
    keys = cut(mixed.select("key").distinct(), "keys")
    drawn = cut(sketched(signed.join(few(keys), "key", "left_semi"), count), "sketches")
    drop(keys)
    pairs = _likely_within(mixed.where(F.col("n") <= MIDDLE).withColumns({"size": F.lit(1), "filed": F.lit(True)}), drawn, count, fewest, least)
    crowded = cut(mixed.where(F.col("n") > MIDDLE).select("key").distinct(), "crowded")
    if not crowded.isEmpty():
        rows = cut(shingled(found.join(few(crowded), "key", "left_semi")), "shingled")
        rare = cut(_mixed(cut(_labelled(rare_shingles(rows, least), comp), "labelled"), "shingle", F.col("filed")), "rare")
        drop(rows)
        some = rare.where(F.col("n") <= MIDDLE).withColumnRenamed("shingle", "group")
        pairs = pairs.unionByName(_likely_within(some, drawn, count, fewest_equal(count, 0, least), least)).distinct()
        many = cut(rare.where(F.col("n") > MIDDLE), "many")
        if not many.isEmpty():
            # texts meet their keys before they are cut into shingles: a join row a text, not one a shingle
            keys = cut(many.select("key").distinct(), "keys")
            sets = cut(shingled(found.join(few(keys), "key", "left_semi")).groupBy("key").agg(F.collect_list("shingle").alias("held")), "sets")
            links = links.unionByName(_links_within(many, sets, least))
    links = links.unionByName(verified(cut(pairs, "pairs"), found, alike, least, size))
    for table in (comp, found):
        drop(table)
    comp = cut(components(links, "a", "b"), "comp")
    return comp


def with_hot(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``sizes`` (one row a ``key``, with a count ``n`` of its rows); a key of very many rows is not gathered.

    Keys with more than a ten-thousandth of all rows are at most 10,000: they are broadcast. The others are joined by a shuffle.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(1000, total / 10_000)
    met = rows.join(F.broadcast(sizes.where(hot)), key)
    cold = rows.join(F.broadcast(sizes.where(hot).select(key)), key, "left_anti").join(sizes.where(~hot), key)
    return met.unionByName(cold)
