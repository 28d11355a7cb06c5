import random
import re

from gridloom.llm import urls

URLS = [
    "http://example.com/en/7", "https://www.example.com/en/728?x", "https://a.example.com/en/8#t", "http://other.com/en/", "http://com/en/x", "http://notcom/en/x", "http://x.net/de/1",
    "http://example.net/de/8", "http://sub.example.net/de/81", "http://X.ORG/es/", "http://x.org/ES/", "http://x.org/es", "ftp://casino-win.example.org/a", "http://example.org/pills", "http://example.org/pillsbury",
    "http://a.b/spam/policy/x", "no scheme com/en/", "", None, "http://", "http://h", "http://h?q=/en/", "http://example.com/en/7/casino", "http://mexample.com/en/7", "http://x.com:80/en/1", "a://b://c.com/en/",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate({c: c + 32 for c in range(65, 91)})
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(h + p, v) for h, p, v in urls.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, verdict = max(fits, key=lambda f: len(f[0]))
        return host, path, rule, verdict
    words = re.split(r"[^a-z0-9]+", (host + path).lower())
    block = any(p.strip("^") in words for p, v in urls.PATTERNS if v == "block")
    return host, path, None, "block" if block else "allow"


def test_against_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "html", "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "again", "x"), (None, URLS[0], "", "x")], "page_id long, url string, html string, rule string")
    got = urls.judge(pages, urls.site_rules(spark), urls.patterns(spark)).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        u = URLS[0] if r["page_id"] is None else URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(u), u
    assert urls.judge(pages.limit(0), urls.site_rules(spark), urls.patterns(spark)).collect() == []


def test_rules_without_a_bounded_token_are_tried_on_all(spark):
    pages = spark.createDataFrame([(1, "http://x.y/bannerads9"), (2, "http://x.y/other"), (3, None)], "page_id long, url string")
    got = urls.judge(pages, urls.site_rules(spark), urls.patterns(spark, [("*ads*", "block"), ("^x.y/oth*", "allow"), (None, "block")])).collect()
    assert {r["page_id"]: (r["verdict"], r["pattern"]) for r in got} == {1: ("block", "*ads*"), 2: ("allow", "^x.y/oth*"), 3: ("allow", None)}


def test_each_rule_is_filed_under_tokens_it_needs(spark):
    rows = {r["rule"] or r["pattern"]: set(r["tokens"]) for r in urls.compiled(urls.site_rules(spark), urls.patterns(spark)).collect()}
    assert rows["com/en/"] == {"com", "en"} and rows["example.com/en/7"] == {"example", "com", "en"} and rows["^casino^"] == {"casino"}


def matches(pattern, text):
    """A pattern on a lower-case text, place by place."""
    start, pattern = pattern.startswith("||"), pattern.removeprefix("||")
    end, pattern = pattern.endswith("|"), pattern.removesuffix("|")
    host = text.split("/", 1)[0]
    at = {0, *(i + 1 for i, c in enumerate(host) if c == ".")} if start else set(range(len(text) + 1))
    for c in pattern:
        beyond = lambda i: i < len(text) and not re.match("[a-z0-9]", text[i])
        if c == "*":
            at = set(range(min(at), len(text) + 1)) if at else set()
        elif c == "^":  # a place at either end, or one such character
            at = {i + 1 for i in at if beyond(i)} | {i for i in at if i in (0, len(text))}
        else:
            at = {i + 1 for i in at if text[i : i + 1] == c}
    return len(text) in at if end else bool(at)


def test_thousands_of_rules_of_a_list(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdef0") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    name = lambda: rng.choice(names)
    kinds = [
        lambda: f"||{name()}.com^", lambda: f"||{name()}.{name()}.net/{name()}", lambda: f"^{name()}^", lambda: f"/{name()}/{name()}/", lambda: f"/{name()}/*{name()}|",
        lambda: f".{name()}/{name()}^", lambda: f"{name()}-{name()}.", lambda: f"||{name()}.com/*^{name()}^", lambda: f"{name()}{name()}{name()}", lambda: f"/{name()}.{name()}|", lambda: f"||{name()}$|",
    ]
    wanted = [("@@" if rng.random() < 0.2 else "") + rng.choice(kinds[:-1])().upper() for _ in range(4000)]
    dropped = ["! a comment", "[Adblock Plus 2.0]", "  ", None, "a.com##.banner", "a.com#@#.x", "||a.com^$third-party", "|http://a.com/", "@@|b", "||", "*", kinds[-1]()]
    lines = spark.createDataFrame([(x, i) for i, x in enumerate(wanted + wanted[:50] + dropped)], "line string, pattern long")
    globs = urls.filter_lines(lines)
    found = {(r["pattern"], r["verdict"]) for r in globs.collect()}
    assert found == {(w.removeprefix("@@"), "allow" if w.startswith("@@") else "block") for w in wanted} and globs.count() == len(found)

    pages = [(i, f"https://{name()}.{rng.choice([name(), name() + '-' + name()])}.{rng.choice(['com', 'com', 'com', 'net'])}/{'/'.join(name() + rng.choice(['', '.', '-']) + name() for _ in range(rng.randint(0, 3)))}") for i in range(300)]
    got = urls.judge(spark.createDataFrame(pages + pages[:9], "page_id long, url string"), urls.site_rules(spark, [("zz", "/", "block")]), globs).collect()
    assert len(got) == 309
    some = set()
    for r in got:
        text = (r["host"] + r["path"]).lower()
        fits = [(p, v) for p, v in found if matches(p.lower(), text)]
        block = sorted(p for p, v in fits if v == "block")
        want = ("block", block[0]) if block else ("allow", min((p for p, v in fits), default=None))
        assert (r["verdict"], r["pattern"]) == want, (text, fits)
        some.add(want[1])
    assert len(some) > 50


def test_very_long_urls(spark):
    long = "http://a.com/" + "/".join(str(n) for n in range(20000))
    pages = spark.createDataFrame([(1, long + "/casino/x"), (2, long), (3, "http://a.com/" + "x" * 500_000), (4, "http://x.org/es/" + "é" * 100_000)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, urls.site_rules(spark), urls.patterns(spark)).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {1: "block", 2: "allow", 3: "allow", 4: "block"}
    assert got[1]["path"] == long.removeprefix("http://a.com") + "/casino/x" and got[4]["rule"] == "org/es/"
