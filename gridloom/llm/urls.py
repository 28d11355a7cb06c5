"""URL filters: pattern rules indexed by their rarest literal token, with DataFrame operations only.

Two kinds of rules become regular expressions with the literal tokens (runs of a-z and 0-9) that any match must contain:

* site rules (host, path, verdict), for a host and its subdomains where the path starts with the rule's; the longest wins;
* patterns (pattern, verdict) for everything else, on the lower-case host and path: ``*`` stands for any characters and ``^``
  for a place beside a character that is no letter or digit; ``||`` in front binds a pattern to the host or one of its
  subdomains, ``|`` at the end to the end of the path. A blocking pattern wins over an allowing one. ``filter_lines`` reads
  patterns from lines of a filter list.

Tokens are counted over all URLs. Each rule is filed under its rarest token, the tokens of a URL fetch the rules filed under
them, and only those rules' regular expressions run on that URL. Tokens meet rules under a 64-bit key of the URL, which fetches
its text once for each candidate; where two URLs share a key, each is held against the other's candidates too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts in which the URLs of a token (such as com) meet its rules.
SALTS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
SITE_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: (pattern, verdict)
PATTERNS = [(f"^{word}^", "block") for word in ("adult", "casino", "escort", "gambling", "lottery", "payday", "pills", "poker", "porn", "spam", "viagra", "xxx")] + [("^spam^policy^", "allow")]


def _table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of strings from literals."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def site_rules(spark: SparkSession, rules: list[tuple] = SITE_RULES) -> DataFrame:
    return _table(spark, ["host", "path", "verdict"], rules)


def patterns(spark: SparkSession, rules: list[tuple] = PATTERNS) -> DataFrame:
    return _table(spark, ["pattern", "verdict"], rules)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filter_lines(lines: DataFrame) -> DataFrame:
    """Patterns (pattern, verdict) from the column ``line`` of a filter list, repeated ones once.

    A line is a pattern that blocks, or allows after ``@@``. Left out are null and blank lines, comments (``!``), headers
    (``[``), rules on elements of a page (``##`` and the like), and rules with options (``$``) or bound to the scheme (one
    ``|`` in front), for neither can be decided from host and path.
    """
    line = F.trim(F.col("line"))
    found = lines.select(F.regexp_replace(line, "^@@", "").alias("pattern"), F.when(line.startswith("@@"), "allow").otherwise("block").alias("verdict"), line.alias("whole"))
    return found.where(r"pattern RLIKE '[^|*^ ]' AND NOT whole RLIKE '^[!\\[]|#[@?$%]*#|[$]|^(@@)?[|]([^|]|$)'").select("pattern", "verdict").distinct()


def _tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+")), lambda t: t != "")


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.+?(){}\[\]$|^*])", r"\\$1")


def compiled(sites: DataFrame, globs: DataFrame) -> DataFrame:
    """Rules (rule, pattern, verdict, regex, tokens). A rule without a host, path, pattern or verdict is left out.

    The tokens of a rule are those runs that are bounded on both sides within it: at its ends, or beside a ``*``, a run may go
    on in the URL.
    """
    whole = F.concat("host", "path")
    # a host starts at a boundary; the end of the path is one only if it is no letter or digit
    bounded = F.regexp_replace(whole, "[A-Za-z0-9]+$", "")
    site = sites.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.concat("host", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))).alias("rule"),
        F.lit(None).cast("string").alias("pattern"), "verdict", F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(whole)).alias("regex"), _tokens(bounded).alias("tokens"),
    )
    inner = F.regexp_replace(F.lower("pattern"), "^[a-z0-9]+|[a-z0-9]+$|[a-z0-9]*[*][a-z0-9]*", " ")
    any_ = F.replace(_quoted(F.lower("pattern")), F.lit(r"\*"), F.lit(".*"))
    any_ = F.replace(any_, F.lit(r"\^"), F.lit("(?:[^a-z0-9]|^|$)"))
    any_ = F.regexp_replace(F.regexp_replace(any_, r"^\\[|]\\[|]", r"^(?:[^/]*\\.)?"), r"\\[|]$", r"\$")
    glob = globs.where("pattern IS NOT NULL AND verdict IS NOT NULL").select(
        F.lit(None).cast("string").alias("rule"), "pattern", "verdict", any_.alias("regex"), _tokens(inner).alias("tokens"))
    return site.unionByName(glob)


def judge(pages: DataFrame, sites: DataFrame, globs: DataFrame) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, pattern), one for each row of ``pages``.

    rule is the longest site rule that fits, pattern the first pattern by name among those of the winning verdict where no
    site rule fits; without any the verdict is allow. A null URL, and one without ``://``, has an empty host and path and is
    allowed. Null page_ids and repeated rows stay. Other columns of ``pages`` are not read. A rule none of whose literal
    tokens is bounded (such as the pattern ``*ads*``) is tried on every URL.
    """
    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    text = F.concat("host", "path")
    urls = parted.select("host", "path").distinct().withColumn("key", F.xxhash64("host", "path"))
    salt = F.pmod(F.col("key"), F.lit(SALTS)).alias("salt")
    words = urls.select("key", salt, F.explode(F.array_append(_tokens(text), F.lit(""))).alias("token"))

    def salted(side: DataFrame) -> DataFrame:
        return side.withColumn("salt", F.explode(F.array(*(F.lit(n).cast("long") for n in range(SALTS)))))

    rules = compiled(sites, globs)
    filed = rules.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    counts = words.join(salted(filed.select("token").distinct()), ["token", "salt"], "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    key = ["rule", "pattern", "verdict", "regex"]
    index = filed.join(counts, "token", "left").groupBy(*key).agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))

    fits = F.when(F.col("rule").isNotNull(), F.rlike(text, F.col("regex"))).otherwise(F.rlike(F.lower(text), F.col("regex")))
    hits = urls.join(words.join(salted(index), ["token", "salt"]), "key").where(fits)
    best = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("site"),
        F.min(F.when(F.col("pattern").isNotNull(), F.struct((F.col("verdict") != "block").alias("n"), "pattern", "verdict"))).alias("glob"),
    )
    joined = parted.join(best, ["host", "path"], "left")
    verdict = F.coalesce("site.verdict", "glob.verdict", F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("site.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("site").isNull(), F.col("glob.pattern")).alias("pattern"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), site_rules(spark), patterns(spark))


def _sql() -> str:
    sites = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in SITE_RULES)
    globs = ", ".join(f"('{p}', '{p.replace('^', '(?:[^a-z0-9]|^|$)')}', '{v}')" for p, v in PATTERNS)
    return f"""
WITH site(shost, spath, sverdict) AS (VALUES {sites}), pats(gpattern, gregex, gverdict) AS (VALUES {globs}),
r AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
d AS (SELECT DISTINCT host, path FROM u),
s AS (SELECT host, path, arg_max(shost || spath, length(shost || spath)) AS rule, arg_max(sverdict, length(shost || spath)) AS verdict
      FROM d JOIN site ON (host = shost OR ends_with(host, '.' || shost)) AND starts_with(path, spath) GROUP BY host, path),
g AS (SELECT host, path, arg_min(gpattern, (CASE gverdict WHEN 'block' THEN '0' ELSE '1' END) || gpattern) AS pattern,
      arg_min(gverdict, (CASE gverdict WHEN 'block' THEN '0' ELSE '1' END) || gpattern) AS verdict
      FROM d JOIN pats ON regexp_matches(lower(host || path), gregex) GROUP BY host, path)
SELECT u.page_id, u.host, u.path, s.rule, coalesce(s.verdict, g.verdict, 'allow') AS verdict, CASE WHEN s.rule IS NULL THEN g.pattern END AS pattern
FROM u LEFT JOIN s USING (host, path) LEFT JOIN g USING (host, path)"""


QUERIES = {"op6_urls": op6_urls}
ORACLE_SQL = {"op6_urls": _sql()}
