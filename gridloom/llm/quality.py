"""Quality scores from supervised subword embeddings, trained here by stochastic gradient descent in numpy.

Features are words, pairs of neighbouring words and character n-grams (``GRAMS`` bytes long, over the lower-case bytes with their white space), hashed to
``BUCKETS`` rows. A document is the mean of its features' learned vectors, and a softmax over two outputs gives its score.
After training the vectors are folded with the output weights: the score of a document is the logistic of the mean of one
number for each feature, so a whole text is read with a few array operations a byte.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.langid import hashed_sample, trainable

#: Labelled documents of each class that are learned from, at most, and the characters of a longest one.
SAMPLE, LONGEST = 1500, 1 << 17
BUCKETS, SIZE, GRAMS, EPOCHS, RATE, SEED = 1 << 18, 10, (2, 3, 4), 4, 0.6, 4
THRESHOLD = 0.3
#: Bytes that are hashed side by side.
CHUNK = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * MIX
    return ((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - 18)).astype(np.int32)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x100000001B3, np.uint64))


POWERS = _powers(64)


def features(data: np.ndarray, ends: np.ndarray):
    """Yields (buckets, document) of the features of several texts, kind by kind.

    ``data`` holds the lower-case bytes of the texts, each with a space before and behind, and ``ends`` where each ends. An
    n-gram that would reach over the end of its text is none of its features.
    """
    doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    wide = data.astype(np.uint64)
    for n in GRAMS:
        if len(data) < n:
            break
        h = wide[: len(data) - n + 1].copy()
        for i in range(1, n):
            h = h << np.uint64(8) | wide[i : len(data) - n + 1 + i]
        inside = doc[: len(h)] == doc[n - 1 :]
        yield _bucket(h, n)[inside], doc[: len(h)][inside]
    visible = data > 32
    starts = np.flatnonzero(visible & ~np.concatenate([[False], visible[:-1]]))
    if len(starts):
        at = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))[: len(data) - starts[0]][np.maximum(0, np.arange(len(data)) - starts[0])]
        h = np.add.reduceat(np.where(visible, wide * POWERS[at & 63], 0), starts)
        yield _bucket(h, 1), doc[starts]
        # pairs of words by the difference of their hashes: a word said twice falls into one bucket, whichever it is
        together = doc[starts[1:]] == doc[starts[:-1]]
        yield _bucket(h[1:] - h[:-1], 0)[together], doc[starts[1:]][together]


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [b" " + (t or "").encode("utf-8", "surrogatepass").lower() + b" " for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares of its features."""
    out = []
    for t in texts:
        data, ends = joined([t])
        found, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *(b for b, _ in features(data, ends))]), return_counts=True)
        out.append((found, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Folded scores (one number for each bucket) and the bias, learned from texts and their labels 0 and 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    out, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    docs, step, steps = bags(texts), 0, epochs * max(1, len(texts))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, share = docs[i]
            now, step = rate * (1 - step / steps), step + 1
            rows = vectors[at]
            hidden = share @ rows
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= now * np.outer(hidden, p)
            bias -= 0.1 * now * p
            vectors[at] = rows - now * len(at) ** 0.5 * np.outer(share, back)
    folded = vectors @ (out[:, 1] - out[:, 0])
    return folded.astype(np.float32), float(bias[1] - bias[0])


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from at most ``sample`` labelled documents of each class, those of the smallest hashed doc_id.

    Documents whose crc32(doc_id) is divisible by 5 are never learned from, nor are texts of more than ``LONGEST`` characters.
    Null texts count as empty; null labels and values but 0 and 1 are left out. A doc_id with several texts is learned by one
    of them, one with both labels under each. Without any usable row the score is 0.5 everywhere.
    """
    usable = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & trainable("doc_id"))
    # at most 2 x sample rows, so this side may be broadcast
    picked = hashed_sample(usable, "quality", ["doc_id"], sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    rows.sort(key=lambda r: (r["doc_id"], r["quality"]))
    return train([r["text"] for r in rows], np.array([r["quality"] for r in rows]))


def score_texts(texts: list[str | None], model: tuple[np.ndarray, float]) -> np.ndarray:
    folded, bias = model
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
    data, ends = joined(texts)
    for bucket, doc in features(data, ends):
        sums += np.bincount(doc, weights=folded[bucket], minlength=len(texts))
        counts += np.bincount(doc, minlength=len(texts))
    return 1 / (1 + np.exp(-(sums / np.maximum(1, counts) + bias)))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``; only the text is looked at.

    Null texts count as empty; an empty text gets the score of its framing white space. held_out is false for a null doc_id.
    Equal texts get equal scores. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, texts, out, at = b["doc_id"].to_pylist(), b["text"].to_pylist(), [], 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and size < CHUNK:
                    part.append(texts[at + len(part)])
                    size += len(part[-1] or "")
                out += score_texts(part, model).tolist()
                at += len(part)
            held = [k is not None and zlib.crc32(str(k).encode()) % 5 == 0 for k in keys]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(held, pa.bool_()), pa.array(out, pa.float64()), pa.array([int(x >= threshold) for x in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
