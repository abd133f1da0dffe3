"""Operator 8: URL filter rules, indexed by their rarest literal token.

A rule is a regular expression over ``host/path`` with the literal tokens
that any match must hold. It is filed under the one of them that is rarest in
the table's own URLs; a URL's tokens fetch the candidate rules, and only
those are run. A rule without any literal token, such as one for a host beyond
ASCII, is filed under the empty token, which every URL has. A short list of
rules is part of the plan and everything is one projection. A table of rules
is worked up by Spark and joined with the tokens of the different URLs, so it
may have any length and never comes to the driver.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm.shared import UPPER, ascii_lower, table

#: Rules that the plan itself may hold, as literals; more are joined, and broadcast up to so many bytes.
INLINE, MOST_BYTES = 500, 64_000_000
TOKEN = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; longest ``name`` wins among those of one ``tier``, the lower tier before the higher."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    tier: int = 0


def low(text: str) -> str:
    return text.translate(str.maketrans(UPPER, UPPER.lower()))


def site_rule(spec: str, verdict: str) -> Rule:
    """A rule ``host/path`` for the host, its subdomains and every path that begins so."""
    host, slash, path = spec.partition("/")
    if not slash or not host:
        raise ValueError(f"a rule needs a host and a path: {spec!r}")
    host = low(host)  # as the hosts of URLs are
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}"
    # A path may end within a token of the URL; only those before its last separator are sure to be whole.
    sure = re.match(r"(?s)(.*[^A-Za-z0-9])?", path)[0]
    return Rule(spec, verdict, regex, tuple(t for t in re.split(TOKEN, f"{host}/{sure}".lower()) if t))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule of the second tier for hosts with a label that holds all tokens of ``word`` in a row."""
    tokens = tuple(t for t in re.split(TOKEN, word.lower()) if t)
    return Rule(f"word:{word}", verdict, rf"^[^/]*(?<![a-z0-9]){'[^a-z0-9/]'.join(map(re.escape, tokens))}(?![a-z0-9])", tokens, 1)


SITE_RULES = (
    site_rule("net/", "block"),
    site_rule("example.net/en/", "allow"),
    site_rule("example.com/de/", "block"),
    site_rule("org/fr/", "allow"),
)
#: Host words of spam pages; they decide where no site rule does.
WORD_RULES = tuple(map(word_rule, ("cheap-pills", "casino", "free-download", "hot-deals", "adult", "viagra", "win-prize")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, rest, 1)), F.regexp_extract(url, rest, 2)


def rule_rows(rules: DataFrame) -> DataFrame:
    """(rule, verdict, tier, regex, tokens) of a table (rule, verdict), as :func:`site_rule` and :func:`word_rule` make them, by expressions.

    ``host/path`` is a rule for sites, ``word:words`` one for words in hosts.
    Rows without a verdict or of another form raise once there is a URL; repeated ones count once,
    and of a rule with several verdicts the first by name holds. Other columns
    are not looked at.
    """
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    words = F.col("rule").startswith("word:")
    host, path = ascii_lower(F.regexp_extract("rule", "(?s)^([^/]+)/", 1)), F.regexp_extract("rule", "(?s)^[^/]+(/.*)$", 1)
    sure = F.regexp_extract(path, "(?s)^(.*[^A-Za-z0-9])?", 1)
    parts = F.filter(F.split(F.lower(F.substring("rule", 6, 1 << 30)), TOKEN), lambda t: t != "")
    site = F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(host), quoted(path))
    word = F.concat(F.lit("^[^/]*(?<![a-z0-9])"), F.array_join(parts, "[^a-z0-9/]"), F.lit("(?![a-z0-9])"))
    tokens = F.filter(F.array_distinct(F.when(words, parts).otherwise(F.split(F.lower(F.concat(host, sure)), TOKEN))), lambda t: t != "")
    bad = F.col("verdict").isNull() | F.col("rule").isNull() | F.when(words, F.size(parts) == 0).otherwise(host == "")
    held = rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict")).groupBy("rule").agg(F.min("verdict").alias("verdict"))
    told = F.concat(F.lit("a rule needs a host and a path, or words, and a verdict: "), F.coalesce("rule", F.lit("null")))
    # A bad rule has no token, so every URL meets it, and asks for its regular expression.
    regex = F.when(bad, F.raise_error(told).cast("string")).otherwise(F.when(words, word).otherwise(site))
    return held.select("rule", "verdict", words.cast("int").alias("tier"), regex.alias("regex"), F.when(~bad, tokens).alias("tokens"))


def filed_rules(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` (see :func:`rule_rows`) with ``token``, the rarest of theirs in the URLs, empty where they have none."""
    each = rules.select("rule", F.explode("tokens").alias("token"))
    held = parts.select(F.explode("tokens").alias("token")).join(each.select("token").distinct(), "token", "left_semi")
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    return rules.join(rarest, "rule", "left").select("rule", "verdict", "tier", "regex", F.coalesce("best.token", F.lit("")).alias("token"))


def filter_urls_by_table(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As :func:`filter_urls`, with the rules of a table (rule, verdict); an empty one fits nothing."""
    parts = url_parts(pages, id_col, url_col)
    filed = filed_rules(parts, rule_rows(rules))
    # Not by hint: adaptive execution broadcasts the rules where they are small, and splits a frequent token where they aren't.
    return judged(parts, filed.select("token", "regex", F.col("rule").alias("name"), F.col("verdict").alias("by"), "tier"), default).withColumnRenamed("id", id_col)


def token_counts(parts: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of ``tokens``; as many rows reach the driver as the rules have tokens."""
    if len(tokens) > INLINE:
        names = parts.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
        held = parts.select(F.explode("tokens").alias("token")).join(names, "token")
    else:
        held = parts.select(F.explode(F.array_intersect(F.col("tokens"), F.array(*map(F.lit, tokens)))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def url_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, host, path, tokens); every URL has the empty token beside its own."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    tokens = F.split(F.lower(F.concat("host", F.lit(" "), "path")), TOKEN)
    return parts.withColumn("tokens", F.array_union(tokens, F.array(F.lit(""))))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITE_RULES + WORD_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, by_rule.

    ``rule`` is the deciding rule of the first tier or null, ``by_rule`` the
    deciding rule of any tier. The longest fitting name of the lowest tier
    wins, then the first by name. Null and malformed URLs have empty host and
    path, fit no rule and get ``default``. Repeated rows stay repeated; other
    columns are not looked at; an empty table gives an empty result. URLs of
    any length are judged whole.
    """
    parts = url_parts(pages, id_col, url_col)
    if not rules:
        return parts.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("by_rule"))
    counts = token_counts(parts, sorted({t for r in rules for t in r.tokens}))
    filed: dict[str, list[int]] = defaultdict(list)
    order = sorted(rules, key=lambda r: (r.tier, -len(r.name), r.name))
    for k, rule in enumerate(order):
        filed[min(rule.tokens or ("",), key=lambda t: (counts.get(t, 0), t))].append(k)
    if len(rules) > INLINE:
        return joined(parts, order, filed, default).withColumnRenamed("id", id_col)
    # Token to the places of its rules in the order of precedence; a token that no URL has costs nothing.
    index = F.create_map(*(x for t, ks in sorted(filed.items()) for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    regexes = F.array(*(F.lit(r.regex) for r in order))
    keyed = F.filter("tokens", lambda t: t.isin(*sorted(filed)))
    candidates = F.flatten(F.transform(keyed, lambda t: F.element_at(index, t)))
    whole = F.concat("host", "path")
    fitting = F.filter(candidates, lambda k: F.regexp_like(whole, F.get(regexes, k)))
    found = parts.withColumn("k", F.array_min(fitting))

    def of(values: list[str | None]) -> Column:
        # get, not element_at: under ANSI the latter takes a null place for a place in a literal array.
        return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.col("k"))

    return found.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        of([r.name if r.tier == 0 else None for r in order]).alias("rule"),
        F.coalesce(of([r.verdict for r in order]), F.lit(default)).alias("verdict"),
        of([r.name for r in order]).alias("by_rule"),
    )


def joined(parts: DataFrame, order: list[Rule], filed: dict[str, list[int]], default: str) -> DataFrame:
    """The judgement by a table of rules that the driver has."""
    rows = [(t, order[k].regex, order[k].name, order[k].verdict, order[k].tier) for t, ks in filed.items() for k in ks]
    index = parts.sparkSession.createDataFrame(rows, "token string, regex string, name string, by string, tier int")
    if sum(len(t) + 2 * len(x) + 100 for t, x, *_ in rows) <= MOST_BYTES:
        index = F.broadcast(index)
    return judged(parts, index, default)


def judged(parts: DataFrame, index: DataFrame, default: str) -> DataFrame:
    """The judgement by rules (token, regex, name, by, tier): different URLs are joined with them by token, and pages with the judged URLs."""
    urls = parts.select("host", "path", "tokens").distinct()
    hits = urls.select("host", "path", F.explode("tokens").alias("token")).join(index, "token").filter(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    first = F.struct("tier", (-F.length("name")).alias("shorter"), "name", "by")
    best = hits.groupBy("host", "path").agg(F.min(first).alias("best"))
    # Not by hint: a URL of very many pages is split where both sides are exchanged.
    found = parts.select("id", "host", "path").join(best, ["host", "path"], "left")
    return found.select(
        "id",
        "host",
        "path",
        F.when(F.col("best.tier") == 0, F.col("best.name")).alias("rule"),
        F.coalesce("best.by", F.lit(default)).alias("verdict"),
        F.col("best.name").alias("by_rule"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("by_rule")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN regexp_matches(host, '(^|[^a-z0-9])(cheap[^a-z0-9]pills|casino|free[^a-z0-9]download|hot[^a-z0-9]deals|adult|viagra|win[^a-z0-9]prize)($|[^a-z0-9])') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
