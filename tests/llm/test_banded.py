import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import banded, lines, passages
from tests.llm.test_lines import plain_classes
from tests.llm.util import docs

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


@pytest.fixture(params=[None, (20, 50)], ids=["as set", "small blocks"])
def sizes(request, monkeypatch):
    """Groups of over 20 texts are compared by blocks of some 50, or as the module says."""
    if request.param:
        for name, value in zip(("MIDDLE", "BLOCK"), request.param, strict=True):
            monkeypatch.setattr(banded, name, value, raising=False)


def forms(rng, template, unit, long, short):
    """Rows of six forms. Only the two short rows of a form are similar, and all that they share the others share, too."""
    texts, pairs = [], []
    for _ in range(6):
        common, at = template(), rng.sample(range(300), 2)
        pairs.append((len(texts) + min(at), len(texts) + max(at)))
        texts += [common + "".join(unit() for _ in range(short if i in at else rng.choice(long))) for i in range(300)]
    return texts, pairs


def test_lines_alike_only_in_what_many_strangers_share(spark, sizes):
    rng = random.Random(31)
    draw = lambda: rng.choice(LETTERS)
    texts, pairs = forms(rng, lambda: "".join(draw() for _ in range(144)), draw, range(22, 25), 16)  # 140 / 172, most strangers 140 / 178 or less
    got = {r["doc_id"]: r["component_id"] for r in lines.line_classes(docs(spark, texts)).collect()}
    rows = list(enumerate(texts))
    want = {at: c for f in range(0, len(rows), 300) for (at, _), (c, _) in plain_classes(rows[f : f + 300]).items()}
    assert got == want and all(want[a] == want[b] for a, b in pairs)


def test_semi_joins_take_a_row_a_text(spark, monkeypatch):
    """Not one for each shingle, of which texts of large groups have hundreds."""
    for name, value in (("MIDDLE", 20), ("BLOCK", 50)):
        monkeypatch.setattr(banded, name, value)
    frame, taken = type(spark.range(0)), []
    join = frame.join

    def counting(self, other, on=None, how=None):
        if how == "left_semi":
            taken.append(self.count())
        return join(self, other, on, how)

    rng = random.Random(36)
    draw = lambda: rng.choice(LETTERS)
    common = "".join(draw() for _ in range(144))
    texts = [common + "".join(draw() for _ in range(16 if i < 2 else 24)) for i in range(120)]
    monkeypatch.setattr(frame, "join", counting)
    got = {r["doc_id"]: r["component_id"] for r in lines.line_classes(docs(spark, texts)).collect()}
    assert got == {at: c for (at, _), (c, _) in plain_classes(list(enumerate(texts))).items()}
    assert len(taken) > 3 and max(taken) <= len(texts)


def test_passages_alike_only_in_what_many_strangers_share(spark, sizes):
    rng = random.Random(35)
    word = lambda: " " + "".join(rng.choices(LETTERS, k=7))
    texts, pairs = forms(rng, lambda: "".join(word() for _ in range(84)).strip(), word, range(20, 25), 9)  # 80 / 98, strangers 80 / 109 at most
    got = {r["doc_id"]: r["component_id"] for r in passages.repeated_passages(docs(spark, texts)).where("start_word = 0 AND end_word = 93").collect()}
    # windows within the form are shared by all; whole rows only by the pairs
    assert got == {at: a for a, b in pairs for at in (a, b)}


def test_pairs_of_buckets_whatever_the_batches():
    rng = random.Random(33)
    rows = sorted((b, k) for b in range(-60, 60) for k in rng.sample(range(10_000), rng.choice([1, 1, 2, 3, banded.SMALL, banded.SMALL + 1, 90])))
    small, large = set(), set()
    for b in {b for b, _ in rows}:
        keys = [k for x, k in rows if x == b]
        if len(keys) <= banded.SMALL:
            small |= {(x, y, None) for i, x in enumerate(keys) for y in keys[i + 1 :]}
        else:
            large |= {(keys[0], y, b) for y in keys}
    for size in (1, 7, 64, len(rows)):
        table = pa.table({"bucket": pa.array([b for b, _ in rows]), "key": pa.array([k for _, k in rows])})
        got = [tuple(r.values()) for batch in banded._met(iter(table.to_batches(size))) for r in batch.to_pylist()]
        assert {r for r in got if r[2] is None} == small and sorted(r for r in got if r[2] is not None) == sorted(large)


def test_sets_of_shingles():
    rng = random.Random(34)
    words = [rng.choice("abc") for _ in range(60)]
    spans = [(0, 60), (3, 40), (3, 8), (1, 3), (4, 6), (9, 10)]
    sets = [set(x.tolist()) for x in passages.shingle_sets(words, spans)]
    plain = [{tuple(words[k : min(k + 5, e)]) for k in range(s, max(s + 1, e - 4))} for s, e in spans]
    assert [[len(x & y) for y in sets] for x in sets] == [[len(x & y) for y in plain] for x in plain]
    assert [len(x) for x in passages.shingle_sets(["a"], [(0, 1)])] == [1] and all(x.dtype == np.uint64 for x in passages.shingle_sets(words, spans))


def test_pairs_of_unlike_sizes_fetch_no_sets(spark):
    """A set of under 0.8 of the other's size has no similarity of 0.8; its array takes no part in the joins."""
    sets = {1: list(range(100)), 2: list(range(80)), 3: list(range(79)), 4: list(range(10, 100))}
    found = spark.createDataFrame(list(sets.items()), "key long, text array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    seen = []

    def alike(joined):
        seen.extend((r["a"], r["b"]) for r in joined.select("a", "b").collect())
        return joined.where(banded.jaccard(F.col("left"), F.col("right")) >= 0.8)

    got = banded.verified(spark.createDataFrame(pairs, "a long, b long"), found, alike, 0.8, F.size("text"))
    want = {(a, b) for a, b in pairs if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert {(r["a"], r["b"]) for r in got.collect()} == want == {(1, 2), (1, 4), (2, 3)}
    assert sorted(seen) == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_a_pair_that_meets_in_many_groups_is_one_row(spark):
    """Sketches hold the low bits of each minimum, so that no fewer are equal; a text's pairs of all groups are one row of a task."""
    rng = random.Random(37)
    minima = [[rng.randrange(1 << banded.FIELD) for _ in range(25)] for _ in range(3)]
    minima.append([m if i < 14 else m ^ 1 for i, m in enumerate(minima[0])])
    packed = [(k, *(sum(m << banded.FIELD * n for n, m in enumerate(ms[at : at + 3])) for at in range(0, 25, 3))) for k, ms in enumerate(minima)]
    signed = spark.createDataFrame(packed, "key long, " + ", ".join(f"m{i} long" for i in range(9)))
    drawn = banded.sketched(signed, 25)
    assert len(drawn.columns) == 4
    rows = [(group, key, key, 1, True) for group in range(30) for key in range(4)]
    got = banded._likely_within(spark.createDataFrame(rows, "group long, key long, comp long, size int, filed boolean"), drawn, 25, 12, 0.8)
    assert [tuple(r) for r in got.collect()] == [(0, 3)]
