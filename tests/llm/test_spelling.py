import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import spelling
from tests.llm.util import docs, odd_rows


def plain_counts(rows, noise=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_grouped(counts, step=10, least=7):
    words = {w: n for w, n in counts.items() if n is not None and n >= 2 and len(w) >= least}
    forms, out = {}, {}
    for w, n in words.items():
        found = [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= step * n:
            forms[w] = best
        out[w] = len(found)

    def root(w):
        return root(forms[w]) if w in forms else w

    return {(w, forms.get(w), root(w), n, out[w], words[forms[w]] if w in forms else None) for w, n in words.items()}


def family(seed, letters, bases=12, size=1200):
    rng = random.Random(seed)
    held = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(bases)]
    while len(held) < size:
        w = rng.choice(held)
        i = rng.randrange(len(w))
        w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]])
        held.append(w if len(w) >= 6 else w + "xx")
    return {w: rng.choice([1, 2, 2, 3, 25, 30, 300, 4000]) for w in held}


def run(spark, counts, **kw):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.grouped(df, **kw).collect()}


@pytest.mark.parametrize("letters", ["ab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyzéèñß"])
def test_groups_equal_all_pairs(spark, letters):
    counts = family(len(letters), letters)
    assert run(spark, counts) == plain_grouped(counts)


@pytest.mark.parametrize("crowd", [0, 3])
def test_crowded_keys_lose_nothing(spark, crowd):
    counts = family(3, "abcdé", size=600)
    want = plain_grouped(counts)
    assert run(spark, counts, crowd=crowd) == want
    assert run(spark, counts, crowd=crowd, spare=0) == want  # two symbols for all lengths


def test_chains_and_ties(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zzzzzzz": 2, "zzzzzzy": 20, "zzzzzzx": 20, "qqqqqqq": 2, "qqqqqqqq": 19, "aloneééé": 5, "short": 9, "onceonly": 1}
    got = {r[0]: r[1:] for r in run(spark, counts)}
    assert got["aaaaaaa"] == ("aaaaaab", "aaaabbb", 2, 1, 20) and got["aaaabbb"] == (None, "aaaabbb", 2000, 1, None)
    assert got["zzzzzzz"] == ("zzzzzzx", "zzzzzzx", 2, 2, 20) and got["qqqqqqq"] == (None, "qqqqqqq", 2, 1, None)
    assert got["aloneééé"] == (None, "aloneééé", 5, 0, None) and "short" not in got and "onceonly" not in got


def test_counts_of_runs(spark, monkeypatch):
    rng = random.Random(2)
    words = ["Testing", "tesTing", "Été×÷abc", "longerword", "wāterābcdefgh", "sixlet", "number9number", "x" * 40]
    rows = [*odd_rows(), *((i, " ".join(rng.choices(words, k=30))) for i in range(60)), (9, "abcdefgh" * 9000)]
    want = plain_counts(rows)
    for chunk, held in ((1 << 20, 300_000), (50, 5)):
        monkeypatch.setattr(spelling, "CHUNK", chunk)
        monkeypatch.setattr(spelling, "HELD", held)
        got = spelling.word_counts(docs(spark, rows).repartition(3))
        assert {r.word: r.n for r in got.collect()} == want
    assert {tuple(r) for r in spelling.grouped(got).select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_grouped(want)


def test_empty_and_null(spark):
    assert spelling.grouped(spelling.word_counts(docs(spark, []))).collect() == []
    df = spark.createDataFrame([(None, 5), ("abcdefgh", None)], "word string, n long")
    assert spelling.grouped(df).collect() == []


def test_a_very_long_word(spark):
    long = "".join(random.Random(1).choices("abcdefg", k=60_000))
    counts = {long: 30, long[:500] + long[501:]: 3, long[:-1] + "z": 2}
    got = {r[0]: (r[1], r[4]) for r in run(spark, counts)}
    assert got[long] == (None, 2) and got[long[:-1] + "z"] == (long, 1)


def test_each_pair_of_reduced_words_meets_once():
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abc", k=rng.choice([7, 8]))) for _ in range(300)})
    many = np.full(spelling.LONGEST + 1, 3)
    own, _ = spelling.own_keys(words, many)
    of, key, _ = spelling.neighbour_keys(words, many, 7)
    places = {}
    for i, k in enumerate(own.tolist()):
        places.setdefault(k, []).append(i)
    met = Counter((min(i, j), max(i, j)) for i, k in zip(of.tolist(), key.tolist(), strict=True) for j in places.get(k, []) if i != j)
    for i, a in enumerate(words):
        for j in range(i + 1, len(words)):
            if near(a, words[j]):
                assert (i, j) in met
