"""URL filters: pattern rules found through their rarest literal token.

Each pattern rule is a regular expression with literal tokens that any matching URL contains as
whole tokens (runs of letters and digits, lower case). How many URLs of the table hold each token is
counted, each rule is filed under its rarest one, a URL's tokens fetch the rules filed under them,
and only those rules' expressions run on that URL. A rule without tokens runs on every URL: as part of the plan up to MOST_ALWAYS such rules, beyond
that from rows of so many rules each, with the same results. Expressions see the URL with its scheme and host in lower case.

Above the pattern rules stand host rules (allow or block for a host with its subdomains and a path
prefix); the longest that fits decides, and the pattern rules decide the rest.

Edge cases: a null URL, or one without `://`, has an empty host and path, no rule and the verdict of
the pattern rules on the text as it is (null: allow). Repeated rows are judged one by one; the row
is followed by its id and URL, so repeated or null ids do no harm; ties between rules of equal length
cannot occur between distinct rules; extra columns are ignored; empty tables and empty rule lists work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (action, host, path): the host with all its subdomains, and a prefix of the path after the slash.
HOST_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: (name, expression, literal tokens that every matching URL holds).
PATTERN_RULES = (
    ("spam farm host", r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    ("pill shop host", r"://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    ("casino host", r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    ("adult host", r"://([^/?#]*[.-])?xxx[.-]", ("xxx",)),
    ("feed tracking on org", r"\.org/[^?#]*\?utm_source=feed", ("org", "utm", "source", "feed")),
)
#: Rules without tokens that become part of the plan, at most; and those of a row, where there are more.
MOST_ALWAYS = 500
#: Parts of the URLs that a row of rules without tokens meets apart.
SALTS = 16
#: Broadcasting is left to Spark's own size check above this many rules.
MOST_BROADCAST_RULES = 100_000


def _lower(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(url):
    """The URL with A-Z lower-cased up to the end of its host; as it is where it has none."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(_lower(head), F.substr(url, F.char_length(head) + 1))


def url_parts(url):
    """Host (A-Z lower-cased) and path of a URL column."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)  # after the first ://
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def tokens(url):
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.coalesce(_lower(url), F.lit("")), "[^a-z0-9]+"), lambda t: t != ""))


def host_rule(host, path, rules=HOST_RULES):
    """The longest rule that fits, as struct(action, rule); null where none does."""
    best = None
    for action, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))
        best = F.when(fits, found) if best is None else best.when(fits, found)
    return best if best is not None else F.lit(None).cast("struct<action:string,rule:string>")


def rule_index(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """token, name, pattern: each rule with tokens under the one that the fewest URLs hold (first by name on ties)."""
    wanted = rules.select("name", "pattern", F.explode("tokens").alias("token"))
    counts = urls.select(F.explode(tokens(F.col(url_col))).alias("token")).join(_small(wanted.select("token").distinct(), rules), "token", "left_semi").groupBy("token").count()
    seen = wanted.join(counts, "token", "left").select("name", "pattern", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token").alias("at"))
    return seen.groupBy("name", "pattern").agg(F.min("at").alias("at")).select(F.col("at.token").alias("token"), "name", "pattern")


def _small(df: DataFrame, rules: DataFrame) -> DataFrame:
    return F.broadcast(df) if rules.limit(MOST_BROADCAST_RULES + 1).count() <= MOST_BROADCAST_RULES else df


def _without_tokens(rules: DataFrame) -> DataFrame:
    return rules.where(F.coalesce(F.size("tokens"), F.lit(0)) <= 0).select("name", "pattern").distinct()


def _always(url, rules: list):
    """Names of the rules that match, as an array column."""
    hits = F.array(*(F.when(F.rlike(url, F.lit(r.pattern)), F.lit(r.name)) for r in rules)).cast("array<string>")
    return F.filter(hits, lambda n: n.isNotNull())


def _always_from_rows(urls: DataFrame, rules: DataFrame, count: int) -> DataFrame:
    """_url and name of the rules that match, for urls (distinct, _url); each meets every row of some MOST_ALWAYS rules."""
    rows = -(-count // MOST_ALWAYS)
    packed = rules.groupBy(F.pmod(F.xxhash64("name", "pattern"), F.lit(rows)).cast("int").alias("_row")).agg(F.collect_list(F.struct("name", "pattern")).alias("_rules"))
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = urls.select("_url", lowered(F.col("_url")).alias("_low"), F.pmod(F.xxhash64("_url"), F.lit(SALTS)).cast("int").alias("_salt"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_row"))
    hit = F.filter("_rules", lambda r: F.rlike(F.col("_low"), r["pattern"]))
    return asked.join(packed, ["_row", "_salt"]).select("_url", F.explode(hit).alias("_hit")).select("_url", "_hit.name")


def pattern_rules(spark, rules=PATTERN_RULES) -> DataFrame:
    return spark.createDataFrame([(n, p, list(t)) for n, p, t in rules], "name string, pattern string, tokens array<string>")


def judge(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES) -> DataFrame:
    """id, host, path, rule, verdict and patterns (names of the pattern rules that match) for every row."""
    rules = pattern_rules(pages.sparkSession) if rules is None else rules
    host, path = url_parts(F.col("_url"))
    distinct = pages.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    index = rule_index(pages, rules, url_col)
    fetched = distinct.select("_url", F.explode(tokens(F.col("_url"))).alias("token")).join(_small(index, rules), "token")
    hits = fetched.where(F.rlike(lowered(F.col("_url")), F.col("pattern"))).select("_url", "name")
    always = _without_tokens(rules)
    known = always.orderBy("name", "pattern").limit(MOST_ALWAYS + 1).collect()
    if len(known) > MOST_ALWAYS:
        hits, known = hits.unionByName(_always_from_rows(distinct, always, always.count())), []
    hits = hits.groupBy("_url").agg(F.array_sort(F.collect_set("name")).alias("patterns"))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url")).join(hits, "_url", "left")
    found = rows.select(id_col, host.alias("host"), path.alias("path"), F.array_sort(F.array_union(F.coalesce("patterns", F.array().cast("array<string>")), F.coalesce(_always(lowered(F.col("_url")), known), F.array().cast("array<string>")))).alias("patterns"))
    found = found.withColumn("_rule", host_rule(F.col("host"), F.col("path"), host_rules))
    own = F.when(F.size("patterns") > 0, "block").otherwise("allow")
    return found.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.action", own).alias("verdict"), "patterns")
