r"""Operator 3: secret scan with built-in expressions only.

Three patterns give the base spans. Beside them, long token-like strings are
candidates for the entropy test of their character class: a window slides over
a candidate, the counts of its characters are kept up as one character enters
and one leaves, and windows whose Shannon entropy reaches the threshold of the
class are joined to spans. Candidates that the allow-list names are
suppressed; base spans never are.

All of it is one projection over the documents, so there is no shuffle and no
group that could become hot. Arrays grow block by block, so that a text with
very many matches, or one endless token, costs time in proportion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm.shared import table


@dataclass(frozen=True)
class BaseKind:
    """Spans are matches of ``pattern`` whose ``group`` has ``least`` characters; a text that ``hint`` doesn't find has none."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


BASE = (
    BaseKind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    BaseKind("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    BaseKind("hex", "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)


@dataclass(frozen=True)
class EntropyClass:
    """Candidates that ``test`` finds are judged over windows of ``window`` characters; from ``bits`` on a window is high."""

    kind: str
    test: str
    alphabet: str
    window: int
    bits: float


CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: A candidate belongs to the first class whose test it passes, and passes the last one if no other.
CLASSES = (
    EntropyClass("entropy_hex", "^(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdefABCDEF", 20, 2.9),
    EntropyClass("entropy_base64", "^(?=.*[0-9])(?=.*[A-Z])", f"{LETTERS}0123456789+/_-", 20, 3.65),
    EntropyClass("entropy_base36", "[0-9]", f"{LETTERS[26:]}0123456789+/_-", 20, 3.75),
    EntropyClass("entropy_letters", "^", f"{LETTERS}+/_-", 20, 4.0),
)
#: Candidates that are no secrets: examples and placeholders, one character repeated, counting strings, empty digests.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|dummy|test_?key",
    r"^(.)\1+$",
    r"(?i)^0123456789abcdef",
    r"^(?:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855|da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e)$",
)
#: Entropy is summed in these parts of a bit, as integers, so that the order of sums can't matter.
PARTS = 1_000_000
BLOCK = 256
#: Bits of the count of a character in a window, and counts in one 64-bit number.
BITS, COUNTS = 5, 12
SPAN = "struct<start:bigint,end:bigint,rank:int,kind:string>"
NONE = f"array<{SPAN}>"


def running_sums(lengths: Column) -> Column:
    """array<bigint>: the sums up to and with each item of ``array<bigint>``."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def within(block: Column) -> Column:
        grow = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["sums"], F.array(acc["at"] + x)).alias("sums"))
        return F.aggregate(block, F.struct(zero.alias("at"), none.alias("sums")), grow, lambda acc: acc["sums"])

    total = lambda block: F.aggregate(block, zero, lambda acc, x: acc + x)
    before = F.aggregate(
        blocks,
        F.struct(zero.alias("at"), none.alias("sums")),
        lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums")),
        lambda acc: acc["sums"],
    )
    return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(within(b), lambda x: x + at)))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<end, whole, measured>> of all matches, in code points.

    Matches and the pieces between them come in turn, so ends are running sums of their lengths.
    """
    whole, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    ends = running_sums(F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), whole, lambda p, m: (F.length(p) + F.length(m)).cast("bigint")))
    return F.arrays_zip(ends.alias("end"), whole.alias("whole"), measured.alias("measured"))


def span(start: Column, end: Column, rank: int, kind: str) -> Column:
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))


def base_spans(text: Column, rank: int, kind: BaseKind) -> Column:
    fit = F.filter(matches(text, kind.pattern, kind.group), lambda m: F.length(m["measured"]) >= kind.least)
    spans = F.transform(fit, lambda m: span(m["end"] - F.length(m["whole"]), m["end"], rank, kind.kind))
    return F.when(text.rlike(kind.hint), spans).otherwise(F.array().cast(NONE))


def characters(block: Column, cls: EntropyClass) -> Column:
    """array<struct<word, shift>>: where the count of each character of the block lies in the counts."""
    code = lambda c: F.call_function("locate", c, F.lit(cls.alphabet)) - 1
    found = F.transform(F.split(block, ""), code)
    return F.transform(found, lambda k: F.struct(F.floor(k / COUNTS).cast("int").alias("word"), (F.pmod(k, F.lit(COUNTS)) * BITS).cast("int").alias("shift")))


def window_marks(codes: Column, cls: EntropyClass, most: int) -> Column:
    """A text of a digit for each character of a block: 1 where the window that ends there is full and its sum of n*log2(n) is ``most`` at most.

    The counts of the window's characters are kept up in a few whole numbers,
    BITS bits for each: one character enters, one leaves.
    """
    w = cls.window
    if w >= 1 << BITS:
        raise ValueError(f"a window has {(1 << BITS) - 1} characters at most")
    f = [round(n * math.log2(n) * PARTS) if n else 0 for n in range(w + 2)]
    step_up = F.array(*(F.lit(y - x) for x, y in zip(f, f[1:], strict=False)))  # from n to n + 1 of a character
    none = F.struct(F.lit(-1).alias("word"), F.lit(0).alias("shift"))
    places = F.transform(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: F.struct(F.get(codes, i).alias("into"), F.when(i >= w, F.get(codes, i - w)).otherwise(none).alias("out"), (i >= w - 1).alias("full")))

    def count(counts: Column, c: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, c["word"]), c["shift"]).bitwiseAND((1 << BITS) - 1).cast("int")

    def step(acc: Column, x: Column) -> Column:
        into, out = x["into"], x["out"]
        one = lambda c, k: F.when(c["word"] == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), c["shift"])).otherwise(F.lit(0).cast("bigint"))
        leaves = F.when(out["word"] >= 0, F.get(step_up, count(acc["counts"], out) - 1)).otherwise(0)
        moved = F.when(into == out, 0).otherwise(F.get(step_up, count(acc["counts"], into)) - leaves)
        counts = F.transform(acc["counts"], lambda n, k: n + one(into, k) - one(out, k))
        total = acc["sum"] + moved
        return F.struct(counts.alias("counts"), total.alias("sum"), F.concat(acc["marks"], F.when(x["full"] & (total <= most), "1").otherwise("0")).alias("marks"))

    words = -(-len(cls.alphabet) // COUNTS)
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), words).alias("counts"), F.lit(0).alias("sum"), F.lit("").alias("marks"))
    return F.aggregate(places, start, step, lambda acc: acc["marks"])


def bound(value: Column, of) -> Column:
    """``of(value)``, where the value is worked out once however often it is mentioned; for arrays as results."""
    return F.flatten(F.transform(F.array(value), of))


def high_spans(text: Column, at: Column, rank: int, cls: EntropyClass) -> Column:
    """Spans of joined high windows of the candidate ``text`` that begins at ``at``."""
    w = cls.window
    # The entropy of a window is log2(w) - sum / w. Where characters change within a full window, the one that leaves
    # may still be the one that enters: then nothing moves.
    most = math.floor((math.log2(w) - cls.bits) * w * PARTS)

    def highs(blocks: Column) -> Column:
        def of(b: Column, k: Column) -> Column:
            block = F.concat(b, F.coalesce(F.substring(F.get(blocks, k + 1), 1, w - 1), F.lit("")))
            marks = F.transform(F.array(block), lambda x: F.flatten(F.transform(F.array(characters(x, cls)), lambda codes: F.split(window_marks(codes, cls, most), ""))))
            return bound(F.flatten(marks), lambda m: F.filter(F.transform(m, lambda x, i: F.when(x == "1", k * BLOCK + i + 1 - w)), lambda x: x.isNotNull()))

        return F.flatten(F.transform(blocks, of))

    # Cut in one go: a piece that is cut out by its place costs a walk from the beginning of the text.
    starts = bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), highs)

    def joined(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (x - F.get(s, i - 1) > w))
        last = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1) - x > w))
        return F.zip_with(first, last, lambda a, z: span(at + a, at + z + w, rank, cls.kind))

    return bound(starts, joined)


def entropy_spans(text: Column, classes: tuple[EntropyClass, ...], allow: tuple[str, ...], rank: int) -> Column:
    def of(c: Column) -> Column:
        picked = F.when(F.lit(False), F.array().cast(NONE))
        for k, cls in enumerate(classes):
            picked = picked.when(c["whole"].rlike(cls.test), high_spans(c["whole"], c["end"] - F.length(c["whole"]), rank + k, cls))
        return picked.otherwise(F.array().cast(NONE))

    def allowed(c: Column) -> Column:
        hit = F.lit(False)
        for p in allow:
            hit = hit | c["whole"].rlike(p)
        return hit

    found = F.filter(matches(text, CANDIDATE), lambda c: ~allowed(c))
    return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(found, of))).otherwise(F.array().cast(NONE))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``extra``, arrays of spans (start, end, rank, kind).

    Positions are code points, ends exclusive. A null text counts as empty and
    has no spans. Repeated rows stay repeated, ties of start go by ``rank``,
    an empty table gives an empty result, and other columns are not looked at.
    Texts and candidates of any length are scanned whole, in time that grows
    in proportion: a candidate is cut into blocks once and each character of
    it enters and leaves one window.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*(base_spans(text, k, kind) for k, kind in enumerate(BASE))))
    return docs.select(F.col(id_col).alias("id"), base.alias("base"), entropy_spans(text, classes, allow, len(BASE)).alias("extra")).withColumnRenamed("id", id_col)


def told(spans: Column) -> Column:
    """kind:start:end of each span by start, then rank, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k.kind) for k in BASE),
        F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.concat("base", "extra")).alias("spans"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, 6 AS least,
         regexp_split_to_array(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS p,
         regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS w,
         regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g FROM d
  UNION ALL
  SELECT doc_id, 'access', 1, 20, regexp_split_to_array(t, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}') FROM d
  UNION ALL
  SELECT doc_id, 'hex', 2, 24, regexp_split_to_array(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') FROM d
  UNION ALL
  SELECT doc_id, 'candidate', 3, 20, regexp_split_to_array(t, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}') FROM d),
x AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
f AS (
  SELECT doc_id, kind, rank, w[i] AS c, length(array_to_string(p[1:i], '')) + length(array_to_string(w[1:i], '')) AS e
  FROM x WHERE length(g[i]) >= least),
c AS (
  SELECT doc_id, e - length(c) AS beg, c, CASE
    WHEN NOT regexp_matches(c, '[0-9]') THEN 'entropy_letters'
    WHEN regexp_full_match(c, '[0-9a-f]+|[0-9A-F]+') THEN 'entropy_hex'
    WHEN regexp_matches(c, '[A-Z]') THEN 'entropy_base64' ELSE 'entropy_base36' END AS kind
  FROM f WHERE kind = 'candidate' AND c <> repeat(left(c, 1), length(c))
    AND NOT regexp_matches(c, '(?i)example|sample|placeholder|changeme|dummy|test_?key') AND NOT regexp_matches(c, '(?i)^0123456789abcdef')
    AND c NOT IN ('e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855', 'da39a3ee5e6b4b0d3255bfef95601890afd80709', 'd41d8cd98f00b204e9800998ecf8427e')),
v AS (SELECT doc_id, beg, kind, s, substr(c, s + 1, 20) AS w FROM (SELECT *, unnest(range(0, length(c) - 19)) AS s FROM c)),
h AS (
  SELECT doc_id, beg, kind, s, s - lag(s) OVER (PARTITION BY doc_id, beg ORDER BY s) AS gap FROM v
  WHERE list_sum(list_transform(list_distinct(string_split(w, '')), lambda k: round((length(w) - length(replace(w, k, ''))) * log2(length(w) - length(replace(w, k, ''))) * 1000000)::BIGINT))
        <= floor((log2(20) - CASE kind WHEN 'entropy_hex' THEN 2.9 WHEN 'entropy_base64' THEN 3.65 WHEN 'entropy_base36' THEN 3.75 ELSE 4.0 END) * 20 * 1000000)),
j AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > 20) OVER (PARTITION BY doc_id, beg ORDER BY s) AS part FROM h),
spans AS (
  SELECT doc_id, kind, rank, e - length(c) AS s, e FROM f WHERE kind <> 'candidate'
  UNION ALL
  SELECT doc_id, kind, CASE kind WHEN 'entropy_hex' THEN 3 WHEN 'entropy_base64' THEN 4 WHEN 'entropy_base36' THEN 5 ELSE 6 END, beg + min(s), beg + max(s) + 20 FROM j GROUP BY doc_id, beg, kind, part),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""
