import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import simhash
from gridloom.llm.components import components
from tests.llm.util import docs, groups, odd_rows


def plain_fingerprint(text):
    words = []
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_contract():
    for t in [None, "", "  ", "One", "One two", "A b C a b c a b c", "É è Ü x y", "tab\tline\nfeed\x0bform\x0cend \u00a0 nbsp\u2003em", "w " * 70000]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_spark_hash_agrees(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def brute(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]


def linked(spark, fps, **more):
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    comp = {r["node"] % 2**64: r["comp"] % 2**64 for r in components(simhash.hamming_links(df, **more), "a", "b").collect()}
    return {f: comp.get(f, f) for f in fps}


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:
        for k in (1, 2, 3, 4, 5):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), k)))
    centre = rng.getrandbits(64)
    fps = sorted({*fps, *(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(150)), 0, 2**64 - 1, 7, 2**63})
    want = groups(brute(fps), fps)
    for cell in (4096, 8):  # 8: nearly all goes through the second grid
        got = linked(spark, fps, cell=cell)
        classes = {}
        for f in fps:
            classes.setdefault(got[f], set()).add(f)
        for members in classes.values():
            assert len({want[f] for f in members}) == 1
        assert len(classes) == len(set(want.values()))


def test_manhattan_bounds_hamming():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    assert (np.bitwise_count(simhash.sorted_segments(a) ^ simhash.sorted_segments(b)) <= np.bitwise_count(a ^ b)).all()


def test_groups_on_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(10, base), (7, base.upper().lower()), (12, base + " tail"), (20, "something else entirely with other words"), (21, None), (22, "")]
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    want = groups([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], list(fps))
    assert {i: got[i]["component_id"] for i in fps} == want
    assert all(int(got[i]["fingerprint"], 16) == fps[i] and len(got[i]["fingerprint"]) == 16 for i in fps)


def test_odd_rows(spark):
    got = simhash.simhash_groups(docs(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    assert sorted(r["component_id"] for r in got if r["fingerprint"] == "0" * 16) == [0, 0, 0]
    assert simhash.simhash_groups(docs(spark, [])).collect() == []
    kept = simhash.keep_one(docs(spark, odd_rows()))
    assert kept.columns == docs(spark, []).columns
    assert kept.where("doc_id IS NULL").count() == 1


def test_components_on_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    rng.shuffle(edges)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges + edges[:5] + [(None, 3), (4, 4)], "p long, q long"), "p", "q").collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == groups([e for e in edges if e[0] != e[1]], nodes)


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    texts = [" ".join(f"{c}{i}x{i * 7}" for i in range(60)) for c in "abcde"]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (2, texts[1]), (2, texts[2]), (3, texts[2]), (None, texts[0]), (None, texts[3]), (None, texts[3]), (None, texts[4])]
    got = simhash.keep_one(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", texts[0]), ("2", texts[1]), ("2", texts[2]), ("None", texts[3]), ("None", texts[4])])


def test_keep_one_passes_columns_of_any_name_on(spark):
    text = "a text of some words that two documents share, word by word"
    rows = [(1, text, 5, 6, 7), (2, text, 8, 9, 10), (None, "another text altogether, of other words", 1, 2, 3)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _copy long, _doc long, row long"))
    assert got.columns == ["doc_id", "text", "_copy", "_doc", "row"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[0], rows[2]], key=str)
