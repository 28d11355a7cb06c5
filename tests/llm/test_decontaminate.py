import random

from gridloom.llm import decontaminate as d
from tests.llm.util import docs, odd_rows


def plain_distance(item, text):
    """Least edits of item to a stretch of text, by the table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row), row.index(min(row))


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 140))
        assert d.myers(item, text) == plain_distance(item, text)


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        at = rng.randrange(len(s))
        rng.choice([lambda: s.__setitem__(at, rng.choice("xyz")), lambda: s.insert(at, rng.choice("xyz")), lambda: s.pop(at)])()
    return "".join(s)


def test_search_finds_what_the_table_finds():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 30)))) for i in range(12)]
    searcher = d.Searcher(items)
    for trial in range(60):
        nth = rng.randrange(12)
        budget = int(d.RATE * len(items[nth][1]))
        text = d.plain(" ".join(word() for _ in range(20)) + edited(rng, items[nth][1], rng.choice([0, 1, budget // 2, budget, budget + 4])) + " ".join(word() for _ in range(20)))
        got = {n for n, _, _ in searcher.search(text)}
        want = {i for i, t in items if plain_distance(t, text)[0] <= int(d.RATE * len(t))}
        assert got == want, trial
        assert all(edits == plain_distance(items[n][1], text)[0] for n, edits, _ in searcher.search(text)), trial


def test_the_best_of_several_occurrences_counts():
    rng, item = random.Random(5), "one two three four five six seven eight nine ten"
    searcher = d.Searcher([(0, item)])
    for _ in range(60):
        text = d.plain(" and then ".join(edited(rng, item, rng.randint(0, 4)) for _ in range(4)))
        assert searcher.search(text)[0][1] == plain_distance(item, text)[0]


def test_short_items_are_found_as_whole_words():
    searcher = d.Searcher([(0, "two words"), (1, "a"), (2, "日本語"), (3, "exactly twenty three ch")])
    found = {t: sorted((n, e, end) for n, e, end in searcher.search(t)) for t in ("two words", "say two words here", "two wordsmiths", "xa b", "b a", "x 日本語", "exactly twenty three ch", "exactly twenty three cx")}
    assert found == {"two words": [(0, 0, 9)], "say two words here": [(0, 0, 13)], "two wordsmiths": [], "xa b": [], "b a": [(1, 0, 3)], "x 日本語": [(2, 0, 5)], "exactly twenty three ch": [(3, 0, 23)], "exactly twenty three cx": [(3, 1, 22)]}


def test_items_of_few_characters_have_their_budget_too():
    rng = random.Random(8)
    letters = "abcdefghijklmnop "
    items = [(i, d.plain("".join(rng.choice(letters) for _ in range(40)))[: 10 + i % 14].strip().ljust(10, "q")) for i in range(42)]
    searcher, hits = d.Searcher(items), 0
    for trial in range(300):
        nth = rng.randrange(len(items))
        text = d.plain("".join(rng.choices(letters, k=30)) + " " + edited(rng, items[nth][1], rng.choice([0, 1, 2, 3])) + " " + "".join(rng.choices(letters, k=30)))
        got = {n: e for n, e, _ in searcher.search(text)}
        # the ends of a text are spaces for the search
        want = {i: plain_distance(t, f" {text} ")[0] for i, t in items if plain_distance(t, f" {text} ")[0] <= int(d.RATE * len(t))}
        assert got == want, trial
        hits += nth in got
    assert hits > 100


def test_query(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(25)).capitalize() + ".") for i in range(8)]
    bench = spark.createDataFrame([*items, (90, None), (None, items[0][1]), (91, "too short")], "item_id long, text string")
    rows = [(i, " ".join(word() for _ in range(100))) for i in range(20)]
    for i, nth in ((3, 2), (5, 7), (11, 2)):
        t = rows[i][1]
        rows[i] = (i, t[:50] + " " + items[nth][1].upper().replace(" ", "\n ") + "!! " + t[50:])
    table = docs(spark, [*rows, *((i + 100 if i is not None else None, t) for i, t in odd_rows())])
    want = {(3, 2), (5, 7), (11, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in d.leaks(table, bench).collect()} == want
    monkeypatch.setattr(d, "BLOCK_CHARS", 300)  # several blocks
    assert {(r["doc_id"], r["item_id"]) for r in d.leaks(table, bench).collect()} == want
    kept = d.drop_leaks(table, bench)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in [*(i for i, _ in rows if i not in (3, 5, 11)), *(i + 100 if i is not None else None for i, _ in odd_rows())])
    assert d.leaks(docs(spark, []), bench).collect() == [] and d.leaks(table, bench.limit(0)).collect() == []
    assert d.drop_leaks(table, bench.limit(0)).count() == table.count()
