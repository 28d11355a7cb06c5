import random

import numpy as np
import pytest

from gridloom.llm import passages
from gridloom.llm.banded import jaccard
from tests.llm.util import docs, groups, odd_rows


def make(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(6)
    passage, near = make(rng, 52), make(rng, 80)
    edited = near.split(" ")
    edited[40] = "changedword"
    rows, planted = [], {}
    for i in range(60):
        words = make(rng, rng.randint(60, 400)).split(" ")
        at = rng.randrange(len(words))
        if i % 6 == 0:
            words[at:at] = passage.upper().split(" ") if i % 12 else passage.split(" ")
            planted[i] = (at, at + 52, 0)
        elif i in (7, 33):
            words[at:at] = near.split(" ") if i == 7 else edited
            planted[i] = (at, at + 80, 7)
        rows.append((i, " ".join(words).replace(" q", "\nq") + " Common short footer line."))
    got = passages.repeated_passages(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == set(planted)
    for r in got:
        start, end, first = planted[r["doc_id"]]
        assert start - 5 <= r["start_word"] < r["end_word"] <= end + 5
        # at a passage's edges two copies may share a paragraph that the first one has not
        assert planted[r["component_id"]][2] == first and r["component_id"] <= r["doc_id"] and r["kept"] == (r["doc_id"] == r["component_id"])


def windows(words):
    """Starts of a text's windows, plainly."""
    w = passages._mixed(np.array([passages._hash_of(x) for x in words], np.uint64))
    h = []
    for i in range(len(words) - passages.WIDTH + 1):
        f = w[i]
        for k in range(1, passages.WIDTH):
            f = f * passages._odd + w[i + k]
        h.append(int(passages._mixed(np.array([f]))[0]))
    n = len(words) - passages.WORDS + 1
    if n <= 0:
        return set()
    return {min(range(at, min(at + passages.SPACING, n)), key=h.__getitem__) for at in range(max(1, n - passages.SPACING + 1))}


def stretches(text):
    """Real paragraphs and windows of a text, plainly: (start, end, whether it is a paragraph)."""
    words, real = passages.blocks(text)
    out = {(s, s + passages.WORDS): False for s in windows(words)} | dict.fromkeys(real, True)
    return words, [(s, e, r) for (s, e), r in out.items()]


def test_paragraphs_of_many_texts_equal_those_found_plainly():
    rng = random.Random(7)
    texts = [None, "", "\n", "one", "a b\n\nc", "x " * 100, *("\n".join(make(rng, rng.randint(1, 70)) for _ in range(rng.randint(1, 5))) for _ in range(40))]
    of, start, end, keys, real, minima = passages.signed_paragraphs(texts)
    got = list(zip(of.tolist(), start.tolist(), end.tolist(), real.tolist(), strict=True))
    plain = [stretches(t) for t in texts]
    want = [(i, s, e, r) for i, (words, found) in enumerate(plain) for s, e, r in found if len(set(words)) > 1]
    assert sorted(g for g in got if len(set(plain[g[0]][0])) > 1) == sorted(want)
    assert len(minima) == real.sum()
    by_key = {}
    for (i, s, e, _), k in zip(got, keys.tolist(), strict=True):
        assert by_key.setdefault(tuple(plain[i][0][s:e]), k) == k
    assert len(set(by_key.values())) == len(by_key)


def test_copies_hold_the_same_window_whatever_stands_around():
    rng = random.Random(7)
    words = make(rng, 50).split(" ")
    inner = None
    for _ in range(20):
        before, after = make(rng, rng.randint(1, 90)).split(" "), make(rng, rng.randint(1, 90)).split(" ")
        keys = passages.signed_paragraphs([" ".join(before + words + after)])[3]
        inner = set(keys.tolist()) if inner is None else inner & set(keys.tolist())
    assert inner


def test_result_equals_all_pairs_of_paragraphs(spark):
    rng = random.Random(19)
    base = [make(rng, rng.randint(3, 90)) for _ in range(14)]
    rows = []
    for i in range(50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            line = rng.choice(base).split(" ")
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = make(rng, 1)
            parts.append((make(rng, rng.randint(1, 40)) + " " if rng.random() < 0.2 else "") + " ".join(line))
        rows.append((i, rng.choice(["\n", "\n\n"]).join(parts)))
    plain = {i: stretches(t) for i, t in rows}
    held = {}
    for i, (words, found) in plain.items():
        for s, e, real in found:
            held.setdefault(tuple(words[s:e]), []).append((i, s, e, real))
    sets = {t: {t[k : k + 5] for k in range(max(1, len(t) - 4))} for t, at in held.items() if any(r for *_, r in at)}
    texts = list(sets)
    pairs = [(a, b) for n, a in enumerate(texts) for b in texts[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(pairs, list(held))
    classes = {}
    for t, at in held.items():
        classes.setdefault(root[t], []).extend(at)
    want = {}
    for at in classes.values():
        if len({i for i, *_ in at}) > 1:
            first = min(i for i, *_ in at)
            for i, s, e, _ in at:
                want.setdefault((i, first), set()).update(range(s, e))
    got = {}
    for r in passages.repeated_passages(docs(spark, rows)).collect():
        assert r["kept"] == (r["doc_id"] == r["component_id"])
        got.setdefault((r["doc_id"], r["component_id"]), set()).update(range(r["start_word"], r["end_word"]))
    assert got == want


@pytest.mark.parametrize(("own", "edits"), [(9, 1), (20, 2)])
def test_pairs_among_paragraphs_of_one_template(spark, own, edits):
    """Strangers at 0.79, 0.62 and 0.35 by their common words; planted pairs at 0.87 to 0.97."""
    rng = random.Random(own)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    template, texts = [word() for _ in range(70)], []
    for i in range(3000):
        part = [word() for _ in range(own)]
        texts.append(" ".join([*template, *part]))
        if i % 20 == 0:
            for at in range(edits):  # side by side and at the end, so that few shingles change
                part[-1 - at] = "changed" + word()
            texts.append(" ".join([*template, *part]))
    pairs = [(n, n + 1) for n in range(len(texts) - 1) if "changed" in texts[n + 1]]
    spans = passages.repeated_passages(docs(spark, texts)).where("end_word - start_word >= 70 AND start_word = 0 AND component_id != 0")
    got = {r["doc_id"]: r["component_id"] for r in spans.where(f"end_word = {70 + own}").collect()}
    assert len(pairs) == 150 and sum(a in got and got[a] == got.get(b) for a, b in pairs) >= 0.99 * (len(pairs) - 1)


def test_similarity_is_exact(spark):
    a = [f"w{i}" for i in range(20)]
    b = [*a[2:], "x", "y"]
    sa, sb = ({tuple(t[i : i + 5]) for i in range(16)} for t in (a, b))
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    assert df.select(jaccard(passages.shingles(df["a"]), passages.shingles(df["b"]))).first()[0] == len(sa & sb) / len(sa | sb)


def test_odd_rows(spark):
    assert passages.repeated_passages(docs(spark, odd_rows())).collect() == []
    assert passages.repeated_passages(docs(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    got = passages.repeated_passages(docs(spark, [(4, text), (4, text), (None, text), (9, text)])).collect()
    assert {r["doc_id"] for r in got} == {None, 4, 9} and {r["component_id"] for r in got} == {4}
    nameless = passages.repeated_passages(docs(spark, [(None, text), (None, text)])).collect()
    assert [r["doc_id"] for r in nameless] == [None, None] and sorted(r["kept"] for r in nameless) == [False, True]
    alone = passages.repeated_passages(docs(spark, [(4, text), (4, text)])).collect()
    assert alone == []


def test_bands_miss_few_pairs_of_the_wanted_similarity():
    rng, missed = random.Random(15), 0
    for _ in range(2000):
        words = make(rng, 20).split(" ")
        minima = passages.signed_paragraphs([" ".join(words), " ".join([*words[:18], "x", "y"])])[5]  # 14 / 18
        missed += not any((minima[0, b] == minima[1, b]).all() for b in map(list, passages.BANDS))
    # expected: (1 - 0.778^2)^6, 0.4 %
    assert missed <= 18


def test_real_paragraphs_are_compared_whole(spark):
    rng = random.Random(17)
    short, middle, long = make(rng, 8), make(rng, 30), make(rng, 52)
    edited = long.split(" ")
    edited[25] = "changedword"
    lone = [make(rng, 70) for _ in range(6)]
    rows = [(0, f"{lone[0]}\n{short}"), (1, short.upper()), (2, middle), (3, f"{lone[1]}\n\n{middle}\n{lone[2]}"), (4, f"{lone[3]}\n{long}"), (5, " ".join(edited)), (6, lone[4]), (7, make(rng, 3))]
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["component_id"]) for r in passages.repeated_passages(docs(spark, rows)).collect()}
    assert {(0, 70, 78, 0), (1, 0, 8, 0), (2, 0, 30, 2), (3, 70, 100, 2), (4, 70, 122, 4), (5, 0, 52, 4)} == got


def test_words_of_real_paragraphs():
    text = "One two\n three\n\n\tfour five six seven eight"
    words, real = passages.blocks(text)
    assert words == passages.words_of(text) and set(real) == {(0, 2), (2, 3), (0, 3), (3, 8)}
