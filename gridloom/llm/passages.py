"""Passages that repeat across documents: paragraph MinHash banding, exact Jaccard verification, removals by components.

Paragraphs are lines, and blocks of lines between blank lines, each whole, however short. Each has twelve minima over its
five-word shingles, two to a band: of pairs of similarity 0.8 the six bands miss (1 - 0.8^2)^6, 0.2 %. Candidates are verified by
the exact Jaccard similarity of their shingle sets (0.8 or more; one changed word takes five shingles, so paragraphs of 49 words
or more link with it), and links are joined into components; only those that span two documents or more are reported.

A passage may also be pasted into the middle of a line. So texts are cut by content, too: of every ``SPACING`` neighbouring
shingles the one of smallest hash starts a window of ``WORDS`` words. Copies of a passage of at least SPACING + WORDS + 4 words
(50) hold the same window, whatever stands around them. Windows are compared for equality, as classes of their own: in 16
shingles a changed word leaves no similarity of 0.8, and windows that overlap in one text would only meet each other in the
bands. A passage inside longer lines with an edit in every 50 words is found if one of its windows lies between the edits.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.banded import FIELD, few, jaccard, near_components, with_hot
from gridloom.llm.scratch import cut, drop, told_apart

WIDTH, WORDS, SPACING, SIMILARITY = 5, 20, 26, 0.8
BANDS = [[2 * i, 2 * i + 1] for i in range(6)]
MINIMA = 12
#: Words that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 19

_word = re.compile(r"\w+")
_odd = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_orders = np.random.default_rng(5).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _odd
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """A number for each word, remembered for up to half a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) | len(word) << 32
        return found


_hash_of = _Hashes().__getitem__


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case."""
    return _word.findall((text or "").lower())


def blocks(text: str | None) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text and the stretches of words of its real paragraphs: lines, and blocks of lines between blank lines."""
    words, out, opened = [], {}, 0
    for line in [*(text or "").lower().split("\n"), ""]:
        if not line.strip():
            if len(words) > opened:
                out[opened, len(words)] = None
            opened = len(words)
            continue
        at = len(words)
        words += _word.findall(line)
        if len(words) > at:
            out[at, len(words)] = None
    return words, list(out)


def _along(values: np.ndarray, size: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of each ``size`` neighbouring values, in few passes."""
    done = 1
    while done * 2 <= size:
        values = least(values[:-done], values[done:])
        done *= 2
    return least(values[: len(values) - (size - done)], values[size - done :]) if done < size else values


def _starts(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts of the paragraphs cut by content: positions of a smallest hash among ``SPACING`` neighbours within a text."""
    counts = end - first - WORDS + 1  # possible starts
    free = np.full(len(h) + SPACING, np.uint64(2**64 - 1))
    whole = np.zeros(len(free), bool)  # where SPACING possible starts follow
    for f, n in zip(first.tolist(), counts.tolist(), strict=True):
        if n > 0:
            free[f : f + n] = h[f : f + n]
            whole[f : f + max(0, n - SPACING + 1)] = True
    low = _along(free, SPACING, np.minimum)
    low = np.where(whole[: len(low)], low, np.uint64(0))
    # the greatest of the minima of the windows over a position is its own hash just if it is the minimum of one of them
    reach = _along(np.concatenate([np.zeros(SPACING - 1, np.uint64), low]), SPACING, np.maximum)[: len(h)]
    chosen = reach == free[: len(reach)]
    for f, n in zip(first.tolist(), counts.tolist(), strict=True):
        if 0 < n < SPACING:
            chosen[f + int(h[f : f + n].argmin())] = True
    return np.flatnonzero(chosen & (free[: len(chosen)] != np.uint64(2**64 - 1)))


def signed_paragraphs(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Paragraphs and windows of texts: index of the text, first and end word in it, key, whether it is a paragraph, and the
    minima of those that are (n x MINIMA). Equal words have equal keys."""
    cut_up = [blocks(t) for t in texts]
    sizes = np.array([len(words) for words, _ in cut_up], np.int64)
    end = np.cumsum(sizes)
    first, total = end - sizes, int(end[-1]) if len(end) else 0
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool), np.zeros((0, MINIMA), np.int64)
    w = np.zeros(total + WIDTH, np.uint64)
    w[:total] = np.fromiter(chain.from_iterable(map(_hash_of, words) for words, _ in cut_up), np.uint64, total)
    w = _mixed(w)
    folded = [w[:total]]  # the fold of the words from each place on, of each length up to WIDTH
    for i in range(1, WIDTH):
        folded.append(folded[-1] * _odd + w[i : total + i])
    h = _mixed(folded[-1])

    starts = _starts(h, first, end)
    # a stretch that is both counts as a real paragraph
    real = np.array([(f + s, f + e) for f, (_, spans) in zip(first.tolist(), cut_up, strict=True) for s, e in spans], np.int64).reshape(-1, 2)
    spans = np.concatenate([real, np.stack([starts, starts + WORDS], axis=1)])
    spans, at = np.unique(spans, axis=0, return_index=True)
    s, e, banded = spans[:, 0], spans[:, 1], at < len(real)

    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(total, _odd)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(total, _inverse)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:-1])])
    until = np.maximum(e - WIDTH + 1, s + 1)
    keys = (sums[until] - sums[s]) * back[s]
    short = [(n, np.flatnonzero(e - s == n)) for n in range(1, WIDTH)]
    alone = {n: _mixed(folded[n - 1][s[at]] + np.uint64(n)) for n, at in short}
    for n, at in short:
        keys[at] = alone[n]
    keys = _mixed(keys + (e - s).astype(np.uint64)).view(np.int64)

    begin, stop, of_real = s[banded], until[banded], np.cumsum(banded) - 1
    minima = np.empty((len(begin), MINIMA), np.int64)
    ends = np.stack([begin, stop], axis=1).reshape(-1)
    for i, order in enumerate(_orders):
        drawn = np.append(((h * order) >> np.uint64(64 - FIELD)).astype(np.uint32), np.uint32(0))
        minima[:, i] = np.minimum.reduceat(drawn, ends)[::2] if len(begin) else 0
        for n, at in short:  # all of these are paragraphs
            minima[of_real[at], i] = (alone[n] * order) >> np.uint64(64 - FIELD)
    of = np.searchsorted(end, s, side="right")
    return of, s - first[of], e - first[of], keys, banded, minima


def _paragraphs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, doc, start, end, key, m0, ...) of paragraphs and windows (these without minima); a written table, for which
    each text is read once."""
    words = [f"m{i}" for i in range(MINIMA // 3)]

    def rows(batch: pa.RecordBatch, at: list[int], texts: list[str | None]) -> pa.RecordBatch:
        of, start, end, keys, banded, minima = signed_paragraphs(texts)
        packed = np.zeros((len(words), len(of)), np.int64)
        for i in range(len(words)):
            packed[i, banded] = minima[:, 3 * i] | minima[:, 3 * i + 1] << FIELD | minima[:, 3 * i + 2] << 2 * FIELD
        places = pa.array(np.array(at, np.int64)[of])
        held = [batch["doc_id"].take(places), batch["doc"].take(places), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(keys), *(pa.array(p, mask=~banded) for p in packed)]
        return pa.RecordBatch.from_arrays(held, ["doc_id", "doc", "start", "end", "key", *words])

    def run(batches):
        for batch in batches:
            at, texts, size = [], [], 0
            for i, text in enumerate(batch["text"]):
                at.append(i)
                texts.append(text.as_py())
                size += len(texts[-1] or "") // 6
                if size >= CHUNK:
                    yield rows(batch, at, texts)
                    at, texts, size = [], [], 0
            if at:
                yield rows(batch, at, texts)

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc long, start int, end int, key long, " + ", ".join(f"{w} long" for w in words)
    return cut(docs.select("doc_id", "doc", "text").mapInArrow(run, kinds), "paragraphs")


def shingle_sets(words: list[str], spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """The different hashes of the shingles of stretches of words, one by one; a stretch of under ``WIDTH`` words is one shingle."""
    w = _mixed(np.fromiter(map(_hash_of, words), np.uint64, len(words)))
    folded = w.copy()
    for i in range(1, WIDTH):
        folded = folded[:-1] * _odd + w[i:]
    h, out = _mixed(folded), []
    for start, end in spans:
        if end - start >= WIDTH:
            out.append(np.unique(h[start : end - WIDTH + 1]))
        else:
            fold = w[start : start + 1]
            for i in range(start + 1, end):
                fold = fold * _odd + w[i : i + 1]
            out.append(_mixed(fold + np.uint64(end - start)))
    return out


def _sets(docs: DataFrame, paragraphs: DataFrame, keys: DataFrame) -> DataFrame:
    """One (key, text) for each of ``keys``: the set of the paragraph's shingles, from one document that holds it."""

    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                wanted = wanted.as_py()
                held = shingle_sets(words_of(text.as_py()), [(x["start"], x["end"]) for x in wanted])
                sizes = np.cumsum([0, *map(len, held)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x["key"] for x in wanted], pa.int64()), pa.ListArray.from_arrays(sizes, np.concatenate(held).view(np.int64))], ["key", "text"])

    places = paragraphs.join(few(keys), "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc", "start", "end")).alias("at"))
    wanted = cut(places.groupBy("at.doc").agg(F.collect_list(F.struct("key", F.col("at.start").alias("start"), F.col("at.end").alias("end"))).alias("wanted")), "wanted")
    return docs.select("doc", "text").dropDuplicates(["doc"]).join(wanted, "doc").select("text", "wanted").mapInArrow(run, "key long, text array<long>")


def shingles(text: Column) -> Column:
    """The set of the hashes of a paragraph's five-word shingles, for paragraphs that are columns; texts cut in tasks take
    ``shingle_sets``. The words are split once, as the element of an array of one."""

    def of(words):
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - WIDTH)), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WIDTH)))))

    return F.get(F.transform(F.array(F.split(text, " ")), of), F.lit(0))


def repeated_passages(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, start_word, end_word, component_id, kept): stretches of words that another document repeats.

    Words are counted from 0 over the whole text (runs of letters, digits and underscores); end_word is one past the last.
    component_id is the smallest doc_id that holds the passage, kept is true in that document. Neighbouring paragraphs and windows
    of the same component_id are one stretch. Null and empty texts have no passages; a paragraph of under five words is one shingle.
    Different texts under one doc_id, and rows with a null doc_id, are documents of their own; repeated rows count as one
    document. A null doc_id is component_id only where no other document holds the passage; then one of them is kept. Other
    columns of ``docs`` are not read.
    """
    docs = told_apart(docs.select("doc_id", "text")).select("doc_id", "text", F.xxhash64("doc_id", "_copy").alias("doc"))
    paragraphs = _paragraphs(docs)
    words = [c for c in paragraphs.columns if c.startswith("m")]
    signed = cut(paragraphs.where("m0 IS NOT NULL").groupBy("key").agg(*(F.any_value(w).alias(w) for w in words)), "signatures")
    alike = jaccard(F.col("left"), F.col("right")) >= least
    comp = near_components(signed, BANDS, lambda keys: _sets(docs, paragraphs, keys), lambda pairs: pairs.where(alike), lambda found: found.select("key", F.explode("text").alias("shingle")), least, F.size("text"))
    drop(signed)
    own = paragraphs.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    own = cut(own.join(comp.withColumnRenamed("node", "key"), "key", "left").where("low != high OR comp IS NOT NULL").withColumn("class", F.coalesce("comp", "key")), "own")
    classes = own.groupBy("class").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("component_id")).where("low != high")
    known = cut(own.select("key", "n", "class").join(classes.select("class", "low", "component_id"), "class").select("key", "n", "low", "component_id"), "known")
    kept = F.when(F.col("component_id").isNull(), F.col("doc") == F.col("low")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    shared = with_hot(paragraphs.select("doc_id", "doc", "start", "end", "key"), known, "key").select("doc_id", "doc", "start", "end", "component_id", kept.alias("kept")).distinct()
    along = Window.partitionBy("doc", "component_id").orderBy("start", "end")
    opens = F.coalesce(F.col("start") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = shared.withColumn("opens", opens).withColumn("stretch", F.sum(F.col("opens").cast("int")).over(along))
    spans = marked.groupBy("doc_id", "doc", "component_id", "stretch").agg(F.min("start").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"), F.max("kept").alias("kept"))
    return spans.select("doc_id", "start_word", "end_word", "component_id", "kept")


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_passages": op5_passages}
ORACLE_SQL: dict[str, str] = {}
