"""Small tables for the tests: documents with an extra column and the cases that every operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string"


def docs(spark, texts, lang="en"):
    """Documents of the given texts; (id, text) pairs or texts numbered from 0. Extra columns clash with inner names."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", "y") for i, t in rows], SCHEMA)


def odd_rows():
    return [(0, None), (1, ""), (2, " \n\t "), (3, "word"), (3, "word"), (None, "a b c d e f"), (4, "long " * 30000), (5, "é" * 50 + "\n" + "日本語 " * 20)]


def groups(pairs, nodes):
    """Smallest reachable node of each node, by plain union-find."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
