import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import search
from tests.llm.util import docs, odd_rows


def plain_terms(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain_ranked(rows, items, best):
    counts = [(i, Counter(plain_terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(plain_terms(t))
    out = []
    for i, terms in queries.items():
        scored = []
        for doc, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc is not None, doc))
        out += [(i, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=lambda r: (r[0], r[1]))


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "日本", "A_b", "x-Y9"]
    return [(rng.randrange(n), " ".join(rng.choices(words, k=rng.choice([1, 3, 3, 3, 9, 40])))) for _ in range(n)]


@pytest.mark.parametrize("best", [1, 7, 50])
def test_equals_every_score(spark, best):
    rows = [*odd_rows(), *texts(700), *((900 + i, "w1 w2 copy") for i in range(120)), (None, "w1 w2 copy"), (None, "w1 w2 copy")]
    items = [(1, "w1 W2 w3"), (2, "日本, a.B é"), (3, "nothing like it"), (4, ""), (5, None), (None, "w1"), (1, "copy"), (6, "w5 w5 w5"), (6, "w5 w5 w5"), (7, " ".join(f"w{i}" for i in range(60)))]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int")
    got = search.ranked(docs(spark, rows).repartition(3), table, best).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_ranked(rows, items, best)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "w")], "item_id long, text string")
    assert search.ranked(docs(spark, []), items).collect() == [] == search.ranked(docs(spark, ["w"]), items.limit(0)).collect()
    assert search.ranked(docs(spark, [None, "", "..."]), items).collect() == []


def test_small_parts_and_blocks_of_queries_change_nothing(spark, monkeypatch):
    rows, items = texts(400, 5), [(i, f"w{i} w{i + 1} w{2 * i}") for i in range(25)]
    monkeypatch.setattr(search, "BLOCK_TERMS", 10)
    kept = search.stratified
    monkeypatch.setattr(search, "stratified", lambda *a: kept(*a, rows=8, postings=20))
    got = search.ranked(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_ranked(rows, items, 5)


def test_index_rows_hold_postings_by_tf_within_a_length(spark):
    rows = [(i, t) for i, (_, t) in enumerate(texts(300, 8))]
    terms = sorted({t.encode() for _, x in rows for t in plain_terms(x)})
    held = search.counted(docs(spark, rows), terms)
    n, total = len(rows), sum(len(plain_terms(t)) for _, t in rows)
    seen = {}
    for r in search.stratified(held, n, total, rows=64, postings=200).collect():
        assert len(r.docs) <= 64 and list(zip(r.terms, r.tfs)) == sorted(set(zip(r.terms, r.tfs))) and sum(r.sizes) == len(r.places)
        at = 0
        for term, tf, size in zip(r.terms, r.tfs, r.sizes, strict=True):
            for p in r.places[at : at + size]:
                seen[r.docs[p], terms[term].decode()] = (tf, r.m)
            at += size
    want = {(i, w): (c, 50 + 50 * len(plain_terms(t)) * n // total) for i, t in rows for w, c in Counter(plain_terms(t)).items()}
    assert seen == want


def test_bounds_end_a_visit():
    def stratum(m, ids, tf):
        return m, pa.array(ids), np.array([0]), np.array([tf]), np.array([len(ids)]), np.arange(len(ids))

    v = search.Visitor([np.array([0])], np.array([500]), 2)
    v.visit([stratum(400, [1, 2, 3], 1), stratum(60, [7, 8], 3), stratum(90, [9], 2)])
    assert v.visits == 1 and [d for _, _, d in v.held[0]] == [7, 8]


def test_sql_gives_the_same_rows(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = search.op12_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(search.ORACLE_SQL["op12_search"]).fetchall())


def test_a_long_text_is_split_in_chunks(monkeypatch):
    text = "Ab,cd " * 5000 + "e" * 3000 + "é"
    whole = [t for some in search.terms_of(text) for t in some]
    monkeypatch.setattr(search, "CHUNK", 64)
    assert [t for some in search.terms_of(text) for t in some] == whole == [t.encode() for t in plain_terms(text)]
