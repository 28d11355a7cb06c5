"""Ranked lexical search over a length-stratified index.

A term's impact in a document depends on its count tf there and on the document's length alone, and the length enters as a small
whole number m (100 for a document of mean length). Documents of equal m form a stratum. In a stratum all postings of a term with
equal tf have one impact, so it is computed once for each tf, and a term's largest tf gives the largest impact it can have there:
the sum of these over a query's terms bounds the score of every document of the stratum. A task visits strata for each query in
the order of these bounds, and ends where a bound falls under the score of the last document that the query holds.

The index is a table, one row for a stratum or a part of a large one: its documents, and its postings by (term, tf). Parts have at
most ``ROWS`` documents and about ``POSTINGS`` postings, so a length that a third of all documents share is many rows. Texts are
read once; what is shuffled are the documents' counts of the terms that the queries ask for, which are their postings.

Queries go through the driver in blocks of up to ``BLOCK_TERMS`` terms; each block is searched against all rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import cut

BEST = 50
ROWS, POSTINGS = 4096, 1 << 19
BLOCK_TERMS = 200_000
#: Bytes of a text that are split at once.
CHUNK = 1 << 20

_fold = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, chunk by chunk: runs of letters and digits of ASCII, A-Z in lower case, and of all other characters."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(_fold)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK) if at + CHUNK < len(folded) else len(folded)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def impact(tf, m):
    """What each unit of a term's weight adds to a document's score."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Rows (doc_id, n, terms, tfs): a document's number of terms, and the counts of those that ``terms`` holds, by their places.
    Documents without a term are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = {t: i for i, t in enumerate(terms)}

    def run(batches):
        for batch in batches:
            at, sizes, lengths, ids, tfs = [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                n, tf = 0, Counter()
                for part in terms_of(text.as_py()):
                    n += len(part)
                    tf.update(map(known.get, part))
                tf.pop(None, None)
                if n:
                    at.append(i)
                    sizes.append(n)
                    lengths.append(len(tf))
                    ids.append(np.fromiter(tf.keys(), np.int32, len(tf)))
                    tfs.append(np.fromiter(tf.values(), np.int32, len(tf)))
            ends = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32), pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def stratified(held: DataFrame, documents: int, total: int, rows: int = ROWS, postings: int = POSTINGS) -> DataFrame:
    """The index: rows (m, docs, terms, tfs, sizes, places) of the written table ``held`` of ``counted``.

    docs are in ascending order, nulls first. The four other columns tell, for each term and tf in order, how many documents of
    the row have it, and their places in docs.
    """
    kind = held.schema["doc_id"].dataType.simpleString()
    placed = held.select("doc_id", F.expr(f"50 + (50 * n * {documents}L) div {max(1, total)}L").alias("m"), "terms", "tfs", F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    # strata of more than ``rows`` documents: at most one for every ``rows`` documents
    large = placed.groupBy("m").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    dealt = placed.join(F.broadcast(large), "m", "left").withColumn("part", F.pmod("_salt", F.coalesce(F.ceil(F.col("_n") / rows), F.lit(1)))).where(F.size("terms") > 0)
    sorted_ = dealt.select("m", "part", "doc_id", "terms", "tfs").repartition("m", "part").sortWithinPartitions("m", "part", F.col("doc_id").asc_nulls_first())

    def row(m: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        lists = t["terms"].combine_chunks()
        lengths = np.diff(np.asarray(lists.offsets))
        term, tf = (np.asarray(x.flatten()).astype(np.int64) for x in (lists, t["tfs"].combine_chunks()))
        place = np.repeat(np.arange(t.num_rows), lengths)
        key = term << 32 | tf
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        held = {"terms": key[first] >> 32, "tfs": key[first] & 0xFFFFFFFF, "sizes": sizes, "places": place[order]}
        docs = t["doc_id"].combine_chunks()
        whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, *(pa.array(v, pa.int32()) for v in held.values()))]
        return pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), *whole], ["m", "docs", *held])

    def run(batches):
        parts, now, size = [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m, part = (batch[c].to_numpy() for c in ("m", "part"))
            lengths = np.asarray(batch["terms"].value_lengths())
            cuts = np.append(np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (part[1:] != part[:-1]))), len(m))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if parts and now != (m[a], part[a]):
                    yield row(int(now[0]), parts)
                    parts, size = [], 0
                now = (m[a], part[a])
                while a < b:  # documents until the row is full
                    room = max(1, int(np.searchsorted(np.cumsum(lengths[a:b]), postings - size, "right")))
                    parts.append(batch.slice(a, min(room, b - a)).select(["doc_id", "terms", "tfs"]))
                    size += int(lengths[a : a + room].sum())
                    a += room
                    if size >= postings or a < b:
                        yield row(int(now[0]), parts)
                        parts, size = [], 0
        if parts:
            yield row(int(now[0]), parts)

    return sorted_.mapInArrow(run, f"m long, docs array<{kind}>, terms array<int>, tfs array<int>, sizes array<int>, places array<int>")


class Visitor:
    """Searches index rows for all queries of a block, and keeps each query's best documents."""

    def __init__(self, queries: list[np.ndarray], weights: np.ndarray, best: int):
        self.queries, self.weights, self.best = queries, weights, best
        self.asked = np.concatenate(queries)
        self.of = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        self.held: list[list[tuple]] = [[] for _ in queries]
        self.least = np.ones(len(queries), np.int64)  # the least score that can still enter
        self.visits = 0

    def visit(self, rows: list[tuple]) -> None:
        """Rows (m, docs, terms, tfs, sizes, places) as numpy arrays, docs as an Arrow array."""
        ready, bounds = [], np.empty((len(rows), len(self.queries)))
        for nth, (m, docs, terms, tfs, sizes, places) in enumerate(rows):
            many, which = np.unique(tfs, return_inverse=True)
            value = self.weights[terms] * impact(many.astype(np.int64), m)[which]  # an impact is computed once for each tf
            runs = np.searchsorted(terms, np.arange(len(self.weights) + 1))
            top = np.zeros(len(self.weights))
            last = runs[1:][runs[1:] > runs[:-1]] - 1  # a term's run of largest tf
            top[terms[last]] = value[last]
            bounds[nth] = np.bincount(self.of, top[self.asked], len(self.queries))
            ready.append((docs, value.astype(np.float64), runs, np.append(0, np.cumsum(sizes)), places))
        order = np.argsort(-bounds, axis=0, kind="stable")
        for q in range(len(self.queries)):
            for nth in order[:, q]:
                if bounds[nth, q] < self.least[q]:
                    break
                self._score(q, *ready[nth])

    def _score(self, q: int, docs, value, runs, starts, places) -> None:
        self.visits += 1
        terms = self.queries[q]
        which = _spread(runs[terms], runs[terms + 1])
        low, high = starts[which], starts[which + 1]
        at = places[_spread(low, high)]
        score = np.bincount(at, np.repeat(value[which], high - low), len(docs))  # whole numbers below 2^53: exact
        found = np.flatnonzero(score >= self.least[q])
        if not len(found):
            return
        found = found[np.lexsort((found, -score[found]))[: self.best]]
        new = [(-int(score[i]), doc is not None, doc) for i, doc in zip(found.tolist(), docs.take(pa.array(found)).to_pylist(), strict=True)]
        held = self.held[q] = sorted(self.held[q] + new)[: self.best]
        if len(held) == self.best:
            self.least[q] = -held[-1][0]


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The whole numbers from each low up to its high, one run after the other."""
    n = high - low
    return np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def visited(index: DataFrame, queries: list[tuple[object, list[int]]], weights: list[int], kinds: str, best: int = BEST) -> DataFrame:
    """Rows (item_id, doc_id, score): the best documents of every task for each query, given as (item_id, its terms' places)."""
    asked, names = [np.array(t, np.int64) for _, t in queries], [i for i, _ in queries]
    item, doc = kinds.split(", ")

    def run(batches):
        found = Visitor(asked, np.array(weights, np.int64), best)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                lists = [batch[c][i].values for c in ("docs", "terms", "tfs", "sizes", "places")]
                rows.append((batch["m"][i].as_py(), lists[0], *(x.to_numpy() for x in lists[1:])))
            found.visit(rows)
        out = [(names[q], doc, -score) for q, held in enumerate(found.held) for score, _, doc in held]
        schema = pa.schema([("item_id", to_arrow(item)), ("doc_id", to_arrow(doc)), ("score", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 3, schema, strict=True)], schema=schema)

    return index.mapInArrow(run, f"item_id {item}, doc_id {doc}, score long")


def to_arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of (item_id, its different terms); items stream through the driver."""
    part, size = [], 0
    for row in items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        terms = sorted({t for some in terms_of(row["text"]) for t in some})
        if not terms:
            continue
        if part and size + len(terms) > BLOCK_TERMS:
            yield part
            part, size = [], 0
        part.append((row["item_id"], terms))
        size += len(terms)
    if part:
        yield part


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0, equal scores by doc_id.

    Rows of ``docs`` are documents each, also if a doc_id or a whole row repeats; a null doc_id comes before all others, a null
    text has no terms. Rows of ``items`` under one item_id are one query with the terms of all; items with a null item_id or
    without a term have no rows. An empty table on either side gives an empty result. Other columns are not read.
    """
    kinds = ", ".join(t.schema[c].dataType.simpleString() for t, c in ((items, "item_id"), (docs, "doc_id")))
    joined = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
    out = docs.sparkSession.createDataFrame([], f"item_id {kinds.split(', ')[0]}, doc_id {kinds.split(', ')[1]}, score long")
    for block in _blocks(joined):
        terms = sorted({t for _, some in block for t in some})
        at = {t: i for i, t in enumerate(terms)}
        held = cut(counted(docs, terms), "counted")
        n, total = held.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))]
        index = cut(stratified(held, n, total or 0), "strata")
        out = out.unionByName(cut(visited(index, [(i, [at[t] for t in some]) for i, some in block], weights, kinds, best), "found"))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
    # the tasks' rows of one item in 64 groups first: no group grows with the product of tasks and rows
    for keys in (["item_id", "_group"], ["item_id"]):
        grouped = out if keys == ["item_id"] else out.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(64)))
        out = grouped.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
    return out


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_NO_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NO_TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
m AS (SELECT doc_id, 50 + (50 * n * nn) // l AS m FROM d, s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NO_TERM}')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, nn),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS v FROM tf JOIN w USING (term) JOIN m USING (doc_id)),
r AS (SELECT item_id, doc_id, sum(v)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {BEST}"""

QUERIES = {"op12_search": op12_search}
ORACLE_SQL = {"op12_search": _SQL}
