"""Order-preserving packing of token streams into sequences by dynamic programming over cuts.

The documents of a partition, in their order, form one stream of ids. A cut may fall at the end of a document (free), at the
end of a sentence (``SENTENCE``) or, so that no window is ever too long, at every ``STRIDE`` ids of a stretch without either
(``HARD``). A window of ``length`` ids becomes one sequence; it costs its padding, which is 0 where the length is a power of
two, plus the price of the cut that ends it. With f(j) the least cost of the stream up to cut j,

    f(j) = price(j) + min(min over cuts i in [j - 4096, j) of f(i) + i + 4096 - j,  min over k of f(j - 2^k)),

where the first minimum is that of a sliding window, kept in a monotone queue. A block of the stream ends at the end of a
document once it holds ``BLOCK`` ids, so that memory is bounded; its last window is laid out as powers of two where that is cheaper
than its padding. The cuts are the best ones of each block; the loss against one stream is less than one window's padding a block
(under 0.8 % of its ids).
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import cut
from gridloom.llm.vocab import encoder, public_path

LENGTH = 4096
SENTENCE, HARD = 8, 64
STRIDE, BLOCK = 512, 1 << 19


def sentence_ends(tokenizer) -> np.ndarray:
    """Ids of the tokens that end a sentence: runs of . ! and ? alone."""
    marks = {i for t, i in tokenizer.get_vocab().items() if (s := t.removesuffix("</w>")) and not set(s) - set(".!?")}
    return np.array(sorted(marks), np.int64)


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, marks: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions where the stream may be cut, and the price of each."""
    table = np.zeros(65536, bool)
    table[marks] = True
    sentences = np.flatnonzero(table[ids]) + 1
    at = np.union1d(sentences, doc_ends)
    before = np.concatenate([[0], at[:-1]])
    wide = np.flatnonzero(at - before > stride)
    hard = [np.arange(before[i] + stride, at[i], stride) for i in wide]
    price = np.where(np.isin(at, doc_ends, assume_unique=True), 0, SENTENCE)
    if hard:
        hard = np.concatenate(hard)
        at, price = np.concatenate([at, hard]), np.concatenate([price, np.full(len(hard), HARD)])
        order = np.argsort(at, kind="stable")
        at, price = at[order], price[order]
    return at, price


def best_cuts(at: list[int], price: list[int], length: int = LENGTH) -> tuple[list[int], int]:
    """The cuts of least cost, the last of ``at`` among them, and that cost."""
    powers = [1 << k for k in range(length.bit_length())]
    cost, came = {0: 0}, {}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (position, cost + position), costs ascending
    for j, p in zip(at, price, strict=True):
        while queue[0][0] < j - length:
            queue.popleft()
        origin, best = queue[0]
        best += length - j
        for k in powers:
            i = j - k
            if i in cost and cost[i] < best:
                best, origin = cost[i], i
        best += p
        cost[j], came[j] = best, origin
        g = best + j
        while queue and queue[-1][1] >= g:
            queue.pop()
        queue.append((j, g))
    cuts, j = [], at[-1]
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1], cost[at[-1]]


def close(cuts: list[int], length: int = LENGTH) -> list[int]:
    """Lay the last window out as powers of two where that costs less than its padding."""
    start, end = cuts[-2] if len(cuts) > 1 else 0, cuts[-1]
    n = end - start
    if n.bit_count() > 1 and length - n > HARD * (n.bit_count() - 1):
        parts = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
        cuts = cuts[:-1] + list(start + np.cumsum(parts))
    return cuts


def pack_block(ids: np.ndarray, doc_ends: np.ndarray, marks: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Pieces of one block of the stream: which document, where in it, how long, which sequence, where in that."""
    at, price = possible_cuts(ids, doc_ends, marks, stride=min(STRIDE, length))
    cuts = np.array(close(best_cuts(at.tolist(), price.tolist(), length)[0], length))
    stops = np.union1d(cuts, doc_ends)
    starts = np.concatenate([[0], stops[:-1]])
    doc = np.searchsorted(doc_ends, starts, side="right")
    sequence = np.searchsorted(cuts, starts, side="right")
    doc_starts = np.concatenate([[0], doc_ends[:-1]])
    window_starts = np.concatenate([[0], cuts[:-1]])
    raw, edges = memoryview(ids.astype("<u4").tobytes()), np.stack([starts, stops], axis=1).tolist()
    return {
        "doc": doc, "start": starts - doc_starts[doc], "length": stops - starts, "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in edges]),
        "doc_tokens": (doc_ends - doc_starts)[doc], "sequence": sequence, "offset": starts - window_starts[sequence], "sequences": len(cuts),
    }


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Tokens stay in the task that reads the text; what is written and counted over is the pieces. Sequences are numbered from 0
    over all partitions. Null and empty texts are the end id alone; rows with a null doc_id and repeated rows are packed like
    any other. An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]

    def run(batches):
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(vocabulary, spaced=False)
        marks, end = sentence_ends(code.tokenizer), np.array([end_id], "<u2").tobytes()
        keys, held, sizes, total, base = [], [], [], 0, 0

        def flush():
            nonlocal keys, held, sizes, total, base
            p = pack_block(np.frombuffer(b"".join(held), "<u2"), np.cumsum(sizes), marks, length)
            p["sequence"] = p["sequence"] + base
            base += p["sequences"]
            columns = [pa.array(np.full(len(p["doc"]), part), pa.int64()), pa.array(keys, key_kind).take(pa.array(p["doc"])), *(pa.array(p[n], pa.int64()) for n in names)]
            keys, held, sizes, total = [], [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["part", "doc_id", *names])

        for b in batches:
            key_kind = b["doc_id"].type
            for key, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                ids = code.encode(text.as_py() or "") + end
                keys.append(key)
                held.append(ids)
                sizes.append(len(ids) // 2)
                total += sizes[-1]
                if total >= BLOCK:
                    yield flush()
        if keys:
            yield flush()

    pieces = cut(docs.select("doc_id", "text").mapInArrow(run, f"part long, doc_id {kind}, " + ", ".join(f"{n} long" for n in names)), "pieces")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return pieces.join(parts, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("sequence")).alias("sequence_id"), "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("word_bpe_49k.json"))


def packed_stage(docs: DataFrame) -> DataFrame:
    return pack(docs, public_path("word_bpe_49k.json"))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
