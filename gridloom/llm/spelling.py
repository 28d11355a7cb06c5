"""Spelling variants: words that differ by one code point, each with the far more frequent word that it is a form of.

Candidates come from reduced words. Every letter is hashed to one of a few symbols, and of each reduced word the whole neighbourhood
of one edit is generated: itself (the edit may stay within a symbol), each replacement and each deletion. An insertion is the
deletion of the longer word, and a replacement is generated towards the greater symbol only, so every pair of reduced words within
one edit meets once. Neighbours are joined with the reduced vocabulary by 64-bit keys. Pairs whose letters cannot agree, by a mask
of the letters that occur an odd number of times, fall out within the join; the others are verified on the words themselves.

How few symbols: as many as make the reduced words of a length ``SPARE`` times as many as the vocabulary's words of that length.
Words are compared in the alphabet of the shorter one. So both the neighbours of a word and the words of one key grow slowly with
the vocabulary. Where more than ``CROWD`` words share a key, its neighbourhoods are generated once more in full letters: those
candidates share all letters but one, so no two words meet there that are not near.

Ids follow the order of words, so a tie between words is a tie between ids. Roots are found by doubling: a form is at least
``STEP`` times as frequent as its word, so the longest chain, and the rounds, are a logarithm.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.banded import few
from gridloom.llm.scratch import cut, drop

LEAST, TWICE, STEP, NOISE = 7, 2, 10, 31
SPARE, CROWD = 16, 64
#: Longer words have the alphabet of this length, which is two symbols for any vocabulary below 2^32 / SPARE words.
LONGEST = 32
#: Characters cut at once, different words counted before they are handed on, letters worked on at once.
CHUNK, HELD, LETTERS = 1 << 20, 300_000, 1 << 16

_between = re.compile(rb"[^a-z\xc0-\xff]")
_odd = np.uint64(0x9E3779B97F4A7C15)
_back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _odd
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs_of(text: str | None, least: int = 1) -> Iterator[list[bytes]]:
    """The runs of A-Z, a-z and U+00C0 to U+00FF of a text that are long enough, in Latin-1 with A-Z in lower case, chunk by chunk."""
    raw = (text or "").encode("latin-1", "replace").lower()  # bytes: A-Z only; what Latin-1 lacks ends a run
    pattern = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)
    at = 0
    while at < len(raw):
        stop = _between.search(raw, at + CHUNK) if at + CHUNK < len(raw) else None
        end = stop.start() if stop else len(raw)
        yield pattern.findall(raw, at, end)
        at = end


def word_counts(docs: DataFrame, least: int = LEAST, noise: int = NOISE) -> DataFrame:
    """Rows (word, n): the runs of all texts with ``least`` code points or more, and how often they occur.

    With ``noise``, of runs for which it divides the crc32 h of ``doc_id:run`` the code point h % length is left out first; a
    null doc_id is written as nothing. Null texts have no runs.
    """

    def flushed(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in runs_of(text.as_py(), least):
                    for word, n in Counter(part).items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix) if noise else 1
                        if noise and h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield flushed(held)
                    held = {}
        yield flushed(held)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def alphabets(counts: dict[int, int], spare: int = SPARE) -> np.ndarray:
    """The number of symbols for each length up to ``LONGEST``, from the number of words of each length."""
    return np.array([2] + [max(2, math.ceil((spare * counts.get(n, 0)) ** (1 / n))) for n in range(1, LONGEST + 1)], np.int64)


class Reduced:
    """Some words as flat arrays of letters, and their hashes in reduced or full letters."""

    def __init__(self, words: list[str]):
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.end = np.cumsum(self.sizes)
        self.first = self.end - self.sizes
        self.of = np.repeat(np.arange(len(words)), self.sizes)
        self.hashed = _mixed(self.letters)
        self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(self.sizes.max(initial=0)), _odd)]))
        self.power = self.powers[np.arange(len(self.letters)) - self.first[self.of]]

    def masks(self) -> np.ndarray:
        """Which of 31 kinds of letters a word holds an odd number of times: one edit changes two of them at most."""
        return np.bitwise_xor.reduceat(np.uint32(1) << (self.hashed >> np.uint64(40)).astype(np.uint32) % np.uint32(31), self.first).view(np.int32)

    def symbols(self, many: np.ndarray) -> np.ndarray:
        """Each letter's symbol, with ``many`` symbols for each word."""
        return symbol(self.hashed, np.repeat(many, self.sizes))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((values + np.uint64(1)) * self.power)])

    def whole(self, sums: np.ndarray) -> np.ndarray:
        return sums[self.end] - sums[self.first]

    def without(self, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of words without the letter at each position of ``at``."""
        word = self.of[at]
        return (sums[at] - sums[self.first[word]]) + (sums[self.end[word]] - sums[at + 1]) * _back


def symbol(hashed: np.ndarray, many) -> np.ndarray:
    return (hashed >> np.uint64(20)) % np.asarray(many).astype(np.uint64)


def key_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return _mixed(hashes + _mixed(np.asarray(sizes).astype(np.uint64))).view(np.int64)


def own_keys(words: list[str], many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each reduced word, and its mask."""
    r = Reduced(words)
    return key_of(r.whole(r.sums(r.symbols(many[np.minimum(r.sizes, LONGEST)]))), r.sizes), r.masks()


def neighbour_keys(words: list[str], many: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the word, key, whether the key is its own) of the neighbourhoods of the reduced words."""
    r = Reduced(words)
    a = many[np.minimum(r.sizes, LONGEST)]
    s = r.symbols(a)
    h = r.whole(r.sums(s))
    more = np.repeat(a, r.sizes) - 1 - s.astype(np.int64)  # greater symbols for each letter
    at = np.repeat(np.arange(len(s)), more)
    by = (np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + 1).astype(np.uint64)
    replaced = key_of(h[r.of[at]] + by * r.power[at], r.sizes[r.of[at]])
    s = r.symbols(many[np.minimum(np.maximum(r.sizes - 1, 0), LONGEST)])
    changes = np.append(True, (s[1:] != s[:-1]) | (r.of[1:] != r.of[:-1]))  # equal symbols side by side: one deletion
    gone = np.flatnonzero(changes & (r.sizes[r.of] > least))
    deleted = key_of(r.without(r.sums(s), gone), r.sizes[r.of[gone]] - 1)
    of = np.concatenate([np.arange(len(words)), r.of[at], r.of[gone]])
    return of, np.concatenate([key_of(h, r.sizes), replaced, deleted]), np.arange(len(of)) < len(words)


def full_key(words: list[str]) -> np.ndarray:
    r = Reduced(words)
    return key_of(r.whole(r.sums(r.letters)), r.sizes)


def full_neighbours(word: str, keys: np.ndarray, many: np.ndarray, letters: np.ndarray, least: int) -> np.ndarray:
    """Full keys of the words one edit from ``word`` whose reduced words have one of ``keys``, in the directions of ``neighbour_keys``."""
    r = Reduced([word])
    a, n = int(many[min(len(word), LONGEST)]), len(word)
    s, every = r.symbols(np.array([a])), symbol(_mixed(letters), a)
    h, full = r.whole(r.sums(s))[0], r.whole(r.sums(r.letters))[0]
    out = []
    for i in range(n):  # a replacement by every letter whose symbol is not smaller
        to = (every >= s[i]) & (letters != r.letters[i])
        near = np.isin(key_of(h + (every[to] - s[i]) * r.power[i], np.full(to.sum(), n)), keys)
        out.append(key_of(full + (letters[to][near] - r.letters[i]) * r.power[i], np.full(near.sum(), n)))
    if n > least:
        at = np.arange(n)
        near = np.isin(key_of(r.without(r.sums(r.symbols(many[[min(n - 1, LONGEST)]])), at), np.full(n, n - 1)), keys)
        out.append(key_of(r.without(r.sums(r.letters), at[near]), np.full(near.sum(), n - 1)))
    return np.unique(np.concatenate(out))


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """A batch's words in groups of about ``LETTERS`` letters, with the place of the first."""
    words, at = batch["word"].to_pylist(), 0
    sizes = np.cumsum([len(w) for w in words])
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + LETTERS, "right")))
        yield at, words[at:end]
        at = end


def _targets(vocab: DataFrame, many: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at, words in _grouped(batch):
                key, mask = own_keys(words, many)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch["id"].slice(at, len(words)), pa.array(mask)], ["key", "id", "mask"])

    return vocab.select("id", "word").mapInArrow(run, "key long, id long, mask int")


def _sources(vocab: DataFrame, many: np.ndarray, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at, words in _grouped(batch):
                of, key, own = neighbour_keys(words, many, least)
                mask = Reduced(words).masks()[of]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch["id"].slice(at, len(words)).take(pa.array(of)), pa.array(mask), pa.array(own)], ["key", "id", "mask", "own"])

    return vocab.select("id", "word").mapInArrow(run, "key long, id long, mask int, own boolean")


def _crowded_pairs(vocab: DataFrame, crowded: DataFrame, many: np.ndarray, least: int) -> DataFrame:
    """Rows (a, b) of ids within the keys of ``crowded``, generated in full letters."""
    # at most as many rows as there are code points in use
    letters = np.array(sorted(ord(r[0]) for r in vocab.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().collect()), np.uint64)
    wanted = _sources(vocab, many, least).join(few(crowded), "key").groupBy("id").agg(F.collect_set("key").alias("keys")).join(vocab.select("id", "word"), "id")
    held = _targets(vocab, many).join(few(crowded), "key", "left_semi").select("id").join(vocab.select("id", "word"), "id")

    def near(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                full = full_neighbours(batch["word"][i].as_py(), batch["keys"][i].values.to_numpy(), many, letters, least)
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), batch["id"][i].as_py()))], ["full", "a"])

    def full(batches):
        for batch in batches:
            for at, words in _grouped(batch):
                yield pa.RecordBatch.from_arrays([pa.array(full_key(words)), batch["id"].slice(at, len(words))], ["full", "b"])

    # few rows of much work each: dealt to all tasks, which a shuffle sized by bytes would not do
    tasks = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = wanted.select("id", "word", "keys").repartition(tasks, "id").mapInArrow(near, "full long, a long").join(held.select("id", "word").mapInArrow(full, "full long, b long"), "full")
    return met.where("a != b").select("a", "b")


def near_pairs(vocab: DataFrame, least: int = LEAST, crowd: int = CROWD, spare: int = SPARE) -> DataFrame:
    """Rows (a, a_n, b, b_n): ids and counts of the pairs of different words that are one edit apart, each pair once.

    ``vocab`` is a written table (id, word, n) of different words of ``least`` code points or more.
    """
    counts = vocab.groupBy(F.least(F.char_length("word"), F.lit(LONGEST)).alias("size")).count().collect()  # a row a length
    many = alphabets({r["size"]: r["count"] for r in counts}, spare)
    targets, sources = _targets(vocab, many), _sources(vocab, many, least)
    crowded = cut(targets.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select("key"), "crowded")
    crowds = not crowded.isEmpty()
    if crowds:
        sources = sources.join(few(crowded), "key", "left_anti")
    t = targets.select(F.col("key"), F.col("id").alias("b"), F.col("mask").alias("b_mask")).hint("shuffle_hash")
    alike = (F.bit_count(F.col("mask").bitwiseXOR(F.col("b_mask"))) <= 2) & (~F.col("own") & (F.col("id") != F.col("b")) | F.col("own") & (F.col("id") < F.col("b")))
    pairs = sources.join(t, "key").where(alike).select(F.col("id").alias("a"), "b")
    pairs = pairs.unionByName(_crowded_pairs(vocab, crowded, many, least)) if crowds else pairs
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(vocab.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word"), F.col("n").alias(f"{side}_n")), side)
    return pairs.where(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (id, root) for the written table (id, form): the end of each chain of forms."""
    at = cut(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = cut(at.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not after.where("moved").isEmpty()
        drop(at)
        at = after.select("id", "root")
        at._gridloom_path = after._gridloom_path
        if not moved:
            return at


def grouped(counts: DataFrame, least: int = LEAST, twice: int = TWICE, step: int = STEP, crowd: int = CROWD, spare: int = SPARE) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the words of ``counts`` (word, n) that have ``least`` code points and occur ``twice``.

    n_near counts the words one edit (an inserted, deleted or replaced code point) away; form is the most frequent of them, the
    smallest of equals, if it is ``step`` times as frequent as the word or more, else null; root is the end of the chain of forms, or the word.
    Words are different rows of ``counts``; null words and counts are left out. An empty table gives no rows.
    """
    known = counts.where((F.col("n") >= twice) & (F.char_length("word") >= least)).select("word", "n")
    vocab = cut(known.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = cut(near_pairs(vocab, least, crowd, spare), "pairs")
    ways = pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("id"), F.col(f"{x}_n").alias("n"), F.col(y).alias("form"), F.col(f"{y}_n").alias("form_n")) for x, y in ("ab", "ba")))).alias("w")).select("w.*")
    best = ways.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"), F.min("n").alias("n"))
    far = F.when(-F.col("best.less") >= F.lit(step) * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    near = cut(best.select("id", "n_near", far.alias("far")).select("id", "n_near", "far.form", "far.form_n"), "near")
    forms = near.where("form IS NOT NULL").join(_roots(near.where("form IS NOT NULL")), "id").select("id", "form", "form_n", "root")
    for c in ("form", "root"):
        forms = forms.join(vocab.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word")), c)
    out = vocab.join(near.select("id", "n_near"), "id", "left").join(forms.select("id", "form_word", "root_word", "form_n"), "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op11_spelling": op11_spelling}
ORACLE_SQL: dict[str, str] = {}
