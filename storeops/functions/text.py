"""Names, product words and fields of JSON rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Danish letters and what store ids have in their place.
FOLDED = (("ø", "o"), ("æ", "ae"), ("å", "aa"))
#: Name parts of fields that may hold a cost.
COST_LIKE = "(?i)cost|salary|wage|rate|pay|amount"


def folded(name: Column) -> Column:
    """Lower case without Danish letters."""
    out = F.lower(name)
    for letter, plain in FOLDED:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def product_matches(name: Column, word: str) -> Column:
    """Whether a product name holds the word, whatever the case; a null name doesn't."""
    return F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(word.lower()))


def row_fields(json: Column) -> Column:
    """Field names of a JSON object in order; null for other JSON."""
    return F.json_object_keys(json)


def cost_like_fields(json: Column) -> Column:
    return F.filter(row_fields(json), lambda k: k.rlike(COST_LIKE))


def dept_label(department: Column, store: Column) -> Column:
    """``department → store``, where a missing store is UNKNOWN and a missing department null."""
    return F.concat(F.coalesce(department.cast("string"), F.lit("null")), F.lit(" → "), F.coalesce(store, F.lit("UNKNOWN")))
