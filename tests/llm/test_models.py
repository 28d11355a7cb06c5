import math
import zlib

import numpy as np
import pytest

from gridloom.llm import langid, quality
from tests.llm.util import docs, odd_rows

SF = "/root/testdata/sf0.01"


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    model = langid.ByteTagger(["a", "b", "c"], hidden=3)
    for w in model.weights():
        w[...] = w.astype(np.float64)
    for part in (model.ahead, model.back):
        part.x, part.u = part.x.astype(np.float64), part.u.astype(np.float64)
    model.w, model.b = model.w.astype(np.float64), model.b.astype(np.float64)
    runs, target = [b"abc", b"a", b"cabca", "é".encode()], np.array([0, 1, 2, 1])
    _, grads = model.gradients(runs, target)
    for w, g in zip(model.weights(), grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            if w.shape[0] == 256:
                at = (ord("abc"[rng.integers(0, 3)]), *at[1:])
            keep = w[at]
            w[at] = keep + 1e-3
            up = model.gradients(runs, target)[0]
            w[at] = keep - 1e-3
            down = model.gradients(runs, target)[0]
            w[at] = keep
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3


def plain_states(part, data):
    """One direction of the network over bytes, number by number."""
    n, h, out = part.hidden, [0.0] * part.hidden, []
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for byte in data:
        x = [float(v) for v in part.x[byte]]
        z, r = ([sigmoid(x[k * n + i] + sum(h[j] * float(part.u[j, k * n + i]) for j in range(n))) for i in range(n)] for k in (0, 1))
        c = [math.tanh(x[2 * n + i] + sum(r[j] * h[j] * float(part.u[j, 2 * n + i]) for j in range(n))) for i in range(n)]
        h = [h[i] + z[i] * (c[i] - h[i]) for i in range(n)]
        out.append(h)
    return out


def plain_score(model, text):
    """A document's distribution by windows, position by position."""
    data, n = text.encode(), len(model.languages)
    sums = [0.0] * n
    for core in range(0, len(data), langid.STRIDE):
        a, b = max(0, core - langid.CONTEXT), min(len(data), core + langid.STRIDE + langid.CONTEXT)
        ahead, back = plain_states(model.ahead, data[a:b]), plain_states(model.back, data[a:b][::-1])[::-1]
        for t in range(core, min(len(data), core + langid.STRIDE)):
            state = ahead[t - a] + back[t - a]
            logits = [float(model.b[k]) + sum(v * float(model.w[i, k]) for i, v in enumerate(state)) for k in range(n)]
            whole = math.log(sum(math.exp(v) for v in logits))
            sums = [s + v - whole for s, v in zip(sums, logits, strict=True)]
    p = [math.exp(s / max(1, len(data))) for s in sums]
    return [v / sum(p) for v in p]


def test_scores_equal_those_of_plain_loops(monkeypatch):
    monkeypatch.setattr(langid, "STRIDE", 40)
    monkeypatch.setattr(langid, "CONTEXT", 7)
    rng = np.random.default_rng(2)
    model = langid.ByteTagger(["a", "b", "c"], hidden=4)
    for part in (model.ahead, model.back):
        part.x *= 3
        part.u *= 2
    model.w *= 20
    texts = ["one two three", "é" * 30, "x", *("".join(chr(c) for c in rng.integers(32, 300, n)) for n in (39, 40, 41, 47, 200))]
    got = langid.score_texts(model, texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-4)
    assert np.allclose(langid.score_texts(model, [texts[3]]), got[3:4], atol=1e-5)
    # the network that is trained is the one that scores
    logs, alive = model.label([texts[3].encode()[:40]])
    assert np.allclose(np.exp(logs[:, 0].mean(axis=0)) / np.exp(logs[:, 0].mean(axis=0)).sum(), langid.score_texts(model, [texts[3].encode()[:40].decode("utf-8", "ignore")])[0], atol=5e-2)


def test_sample_is_of_different_texts(spark, corpus):
    rows = [(1, "the same text " * 5)] * 20_000 + [(i, f"text {i}") for i in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang")
    got = langid.hashed_sample(df, "lang", ["doc_id", "text"], 30).collect()
    assert len(got) == 30 == len({r["doc_id"] for r in got})
    assert langid.train_on(df.where("doc_id = 1"), 30) is not None
    labels = df.selectExpr("doc_id", "1 AS quality")
    assert langid.hashed_sample(labels, "quality", ["doc_id"], 1000).count() == 59
    bias = quality.train_on(df, labels, 30)[1]
    assert np.isfinite(bias)


def test_stage_without_a_model_keeps_texts_with_letters(spark):
    rows = [(0, None), (1, ""), (2, "123"), (3, "words"), (3, "words"), (None, "more words")]
    got = langid.drop_unknown(docs(spark, rows, lang=None)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "more words"), (3, "words"), (3, "words")]


def test_stage_rejects_what_the_network_sees_no_language_in(spark, corpus):
    model = langid.train_on(corpus)
    got = langid.predict(corpus, model).join(corpus.select("doc_id", "text"), "doc_id").collect()
    kept = {r["doc_id"] for r in langid.drop_unknown(corpus).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in got if r["lang_pred"] != "und" and r["score"] >= langid.LEAST_SHARE}
    assert {r["doc_id"] for r in langid.drop_unknown(corpus, least=0.999).select("doc_id").collect()} < kept


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_accuracy_on_held_out_documents(spark, corpus):
    got = langid.op8_langid(spark, SF).join(corpus.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_language_of_odd_rows(spark, corpus):
    model = langid.train_on(corpus.where("doc_id < 150"))
    rows = [*odd_rows(), (9, "123 !!! ---"), (10, "the and of with")]
    got = langid.predict(docs(spark, rows), model).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {0, 1, 2, 9}
    assert langid.predict(docs(spark, rows), None).where("lang_pred <> 'und'").count() == 0
    assert langid.train_on(docs(spark, [])) is None
    assert langid.predict(docs(spark, []), model).collect() == []
    assert langid.train_on(docs(spark, [(1, None), (2, "x")], lang=None)) is None


def test_training_ignores_held_out_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    assert langid.train_on(docs(spark, [(held, "some words")])) is None


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.op4_quality(spark, SF).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert len(got) > 30
    assert np.mean([r["predicted"] == r["quality"] for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_quality_features_by_hand():
    data, ends = quality.joined(["ab ab", "", None])
    kinds = list(quality.features(data, ends))
    per = [np.bincount(d, minlength=3).tolist() for _, d in kinds]
    # " ab ab " has 7 bytes; "  " (empty and null) has 2
    assert per == [[6, 1, 1], [5, 0, 0], [4, 0, 0], [2, 0, 0], [1, 0, 0]]
    words = kinds[3][0]
    assert words[0] == words[1]
    one = quality.score_texts(["ab ab"], quality.train(["ab ab", "xy"], np.array([1, 0]), epochs=1))
    two = quality.score_texts(["zz", "ab ab", ""], quality.train(["ab ab", "xy"], np.array([1, 0]), epochs=1))
    assert np.isclose(one[0], two[1])


def plain_bucket(h, kind):
    mix, low = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h = (h + kind) * mix & low
    return ((h ^ h >> 29) * mix & low) >> 46


def plain_features(text):
    """The buckets of a text's features, one by one."""
    data, low, out = b" " + text.encode().lower() + b" ", (1 << 64) - 1, []
    for n in quality.GRAMS:
        out += [plain_bucket(int.from_bytes(data[i : i + n], "big"), n) for i in range(len(data) - n + 1)]
    words, i = [], 0
    while i < len(data):
        if data[i] > 32:
            j = i
            while data[j] > 32:
                j += 1
            words.append(sum(v * 0x100000001B3 ** (k % 64 + 1) for k, v in enumerate(data[i:j])) & low)
            i = j
        i += 1
    out += [plain_bucket(w, 1) for w in words]
    return out + [plain_bucket(b - a & low, 0) for a, b in zip(words, words[1:], strict=False)]


def test_quality_training_and_scores_equal_plain_loops(monkeypatch):
    texts, labels = ["Good words here", "bad  bad", "", "more good words, and longer ones", "é bad"], [1, 0, 0, 1, 0]
    folded, bias = quality.train(texts, np.array(labels), epochs=2)
    rng, size = np.random.default_rng(quality.SEED), quality.SIZE
    start = rng.uniform(-1 / size, 1 / size, (quality.BUCKETS, size)).astype(np.float32)
    vectors, out, b, step = {}, [[0.0, 0.0] for _ in range(size)], [0.0, 0.0], 0
    bags = [plain_features(t) for t in texts]
    for bag in bags:
        for f in bag:
            vectors.setdefault(f, [float(v) for v in start[f]])
    for _ in range(2):
        for i in rng.permutation(len(texts)):
            now, step = quality.RATE * (1 - step / (2 * len(texts))), step + 1
            counts = {f: bags[i].count(f) / len(bags[i]) for f in set(bags[i])}
            hidden = [sum(c * vectors[f][k] for f, c in counts.items()) for k in range(size)]
            logits = [b[o] + sum(hidden[k] * out[k][o] for k in range(size)) for o in (0, 1)]
            p = [math.exp(v) / sum(map(math.exp, logits)) for v in logits]
            p[labels[i]] -= 1
            back = [sum(out[k][o] * p[o] for o in (0, 1)) for k in range(size)]
            out = [[out[k][o] - now * hidden[k] * p[o] for o in (0, 1)] for k in range(size)]
            b = [b[o] - 0.1 * now * p[o] for o in (0, 1)]
            for f, c in counts.items():
                vectors[f] = [v - now * len(counts) ** 0.5 * c * g for v, g in zip(vectors[f], back, strict=True)]
    new = "good words, bad ends"
    known = [sum(vectors[f][k] * (out[k][1] - out[k][0]) for k in range(size)) if f in vectors else sum(float(start[f][k]) * (out[k][1] - out[k][0]) for k in range(size)) for f in plain_features(new)]
    want = 1 / (1 + math.exp(-(sum(known) / len(known) + b[1] - b[0])))
    assert abs(quality.score_texts([new], (folded, bias))[0] - want) < 1e-4


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.train_on(docs(spark, odd_rows()), labels)
    got = quality.scored(docs(spark, odd_rows()), model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    nothing = quality.train_on(docs(spark, []), labels)
    assert quality.score_texts(["a"], nothing)[0] == 0.5
    assert quality.scored(docs(spark, []), model).collect() == []


def test_repeated_and_clashing_labels(spark):
    usable = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    texts = docs(spark, [(i, ("good fine " if i % 2 else "bad poor ") * 9 + str(i)) for i in range(60)])
    rows = [(i, i % 2, "x") for i in usable]
    schema = "doc_id long, quality int, text string"
    once = quality.train_on(texts, spark.createDataFrame(rows, schema))
    again = quality.train_on(texts, spark.createDataFrame(rows + rows[::-1] + [(None, 1, "x"), (rows[0][0], None, "x"), (rows[1][0], 7, "x")], schema))
    assert np.array_equal(once[0], again[0]) and once[1] == again[1]
    both = quality.train_on(texts, spark.createDataFrame([(i, q, "x") for i in usable for q in (0, 1)], schema))
    # a document under both labels says nothing: scores stay near a half, while single labels tell the texts apart
    assert np.abs(quality.score_texts(["good fine", "bad poor"], both) - 0.5).max() < 0.25
    good, bad = quality.score_texts(["good fine", "bad poor"], once)
    assert good > 0.8 and bad < 0.2
