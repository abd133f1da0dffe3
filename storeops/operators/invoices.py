"""Invoice fields from reply texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "supplier string, date date, amount decimal(18,2), bad string"
#: What the scan of a reply knows: depth of braces, whether in a string and after a backslash there, where the object began, and the objects so far.
STATE = "struct<depth:int,quoted:boolean,escaped:boolean,start:int,found:array<struct<start:int,length:int>>>"


def objects(text: Column) -> Column:
    """The outermost balanced ``{...}`` of a text, in order, as texts; braces in strings don't count, nor do quotes outside of objects.

    A brace that is never closed hides what comes after it. Null gives null.
    """
    chars = F.transform(F.split(text, ""), lambda c, k: F.struct(c.alias("c"), (k + 1).alias("at")))
    begin = F.from_json(F.lit('{"depth": 0, "quoted": false, "escaped": false, "start": 0, "found": []}'), STATE)

    def step(s: Column, x: Column) -> Column:
        c, at = x["c"], x["at"]
        inside = s["depth"] > 0
        opens, closes = ~s["quoted"] & (c == "{"), ~s["quoted"] & inside & (c == "}")
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        done = closes & (depth == 0)
        start = F.when(opens & ~inside, at).otherwise(s["start"])
        span = F.struct(start.alias("start"), (at - start + 1).alias("length"))
        return F.struct(
            depth.alias("depth"),
            F.when(~inside, False).when(s["escaped"], s["quoted"]).when(c == '"', ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
            start.alias("start"),
            F.when(done, F.array_append(s["found"], span)).otherwise(s["found"]).alias("found"),
        ).cast(STATE)

    return F.aggregate(chars, begin, step, lambda s: F.transform(s["found"], lambda f: F.substring(text, f["start"], f["length"])))


def parse_invoice_replies(replies: DataFrame) -> DataFrame:
    """Typed supplier, date and amount of each reply: of the first object in it that has such fields, whatever stands around.

    ``ok`` is false where there is none, and all fields are null then. A field
    that is missing or null is null; an object with a field of another type
    doesn't count, nor does one with none of the fields.
    """
    def typed(x: Column) -> Column:
        return F.from_json(x, FIELDS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})

    names = F.array(*(F.lit(n) for n in ("supplier", "date", "amount")))
    named = F.filter(objects(F.col("text")), lambda x: F.arrays_overlap(F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")), names))
    good = F.filter(F.transform(named, typed), lambda f: f.isNotNull() & f["bad"].isNull())
    rows = replies.withColumn("f", F.get(good, F.lit(0))).withColumn("ok", F.col("f").isNotNull())
    return rows.select("id", *(F.col(f"f.{c}").alias(c) for c in ("supplier", "date", "amount")), "ok")


def invoice_rejects(replies: DataFrame) -> DataFrame:
    """Replies (id, text) without such an object."""
    return replies.select("id", "text").join(parse_invoice_replies(replies).filter(~F.col("ok")).select("id"), "id", "left_semi")
