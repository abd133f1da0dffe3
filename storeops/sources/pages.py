"""Landed pages of paginated extracts, samples and audits of sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storeops.functions.text import cost_like_fields, row_fields
from storeops.sources.landing import told


#: Offsets that share a window of a running sum.
STRETCH = 1_000_000


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str, stretch: int = STRETCH) -> DataFrame:
    """Adds the sum of ``value`` over the rows of ``key`` up to and with each, in the order of a whole number.

    Numbers are cut into stretches: one window runs within a stretch and one
    over the sums of stretches, so no key comes whole into one task. Only what
    follows other stretches is joined with their sums, so where keys have one
    stretch each, nothing is. A row without key or number has no sum.
    """
    parts = df.withColumn("_part", F.floor(F.col(order) / stretch)).withColumn("_value", value.cast("bigint")).filter(F.col(key).isNotNull() & F.col("_part").isNotNull())
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(key, "_part").agg(F.sum("_value").alias("_sum"))
    later = sums.select(key, "_part", F.sum("_sum").over(before).alias("_before")).filter("_before <> 0")
    within = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = parts.withColumn(name, F.sum("_value").over(within)).join(later, [key, "_part"], "left")
    return whole.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_value", "_before")


def page_running_total(pages: DataFrame) -> DataFrame:
    """Adds ``rows_so_far`` and whether the extract ends with this page: it is empty, or the total (0 if missing) is reached."""
    rows = pages.withColumn("n_rows", F.coalesce(F.size("data"), F.lit(0)).cast("bigint"))
    rows = running_sum(rows, "endpoint", "offset", F.col("n_rows"), "rows_so_far")
    return rows.withColumn("stops", (F.col("n_rows") == 0) | (F.col("rows_so_far") >= F.coalesce("paging.total", F.lit(0))))


def pages_read(pages: DataFrame) -> DataFrame:
    """The pages up to the one that ends the extract."""
    rows = page_running_total(pages)
    ends = rows.filter("stops").groupBy("endpoint").agg(F.min("offset").alias("last"))
    return rows.join(ends, "endpoint", "left").filter(F.col("last").isNull() | (F.col("offset") <= F.col("last"))).drop("last")


def read_pages(pages: DataFrame) -> DataFrame:
    """All rows of all endpoints in order of pages, duplicates kept."""
    return pages_read(pages).select("endpoint", F.inline("data"))


def extract_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"))


def sample_page(df: DataFrame, order_by: list[str], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows from ``offset`` on in the given order."""
    return df.orderBy(*order_by).offset(offset).limit(limit)


AUDIT = "source string, n_rows bigint, n_columns bigint, declared bigint, problem string"
#: The column in which readers leave the text of rows that they can't parse.
BROKEN = "_corrupt_record"


def _hashed(df: DataFrame) -> Column:
    """A hash of all columns of a row, so that every one is read and parsed; maps have no hash of their own."""
    plain = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("bigint")


def audit_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], totals: dict[str, int | None] | None = None) -> DataFrame:
    """For each source: rows, columns, declared total, and what is wrong: it can't be read, some rows are broken, the rows differ from the total, it is missing.

    Sources come as functions that open them. Those that can be opened are
    read wholly by one plan, a tagged union with one aggregation, so the number
    of jobs doesn't grow with theirs. Only where that plan breaks are they read
    one by one, which tells the culprits; the others keep their counts. One
    row for each of a few names comes to the driver.
    """
    totals = totals or {}
    opened: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, open_ in sources.items():
        try:
            opened[name] = open_()
        except Exception as e:  # whatever the source's own code raises
            failed[name] = f"unreadable: {told(e)}"

    def counted(names: list[str]) -> dict[str, tuple[int, int]]:
        def one(name: str) -> DataFrame:
            df = opened[name]
            broken = F.col(BROKEN).isNotNull() if BROKEN in df.columns else F.lit(False)
            return df.select(F.lit(name).alias("source"), broken.alias("broken"), _hashed(df).alias("hash"))

        rows = reduce(DataFrame.unionByName, map(one, names))
        found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("broken").alias("n_broken"), F.bit_xor("hash").alias("all"))
        return {r["source"]: (r["n"], r["n_broken"]) for r in found.collect()}

    counts: dict[str, tuple[int, int]] = {}
    try:
        counts = counted(list(opened)) if opened else {}
    except Exception:
        for name in opened:
            try:
                counts |= counted([name])
            except Exception as e:  # as above
                failed[name] = f"unreadable: {told(e)}"

    def row(name: str) -> tuple:
        total = totals.get(name)
        if name in failed:
            return name, None, None, total, failed[name]
        n, n_broken = counts.get(name, (0, 0))
        problem = f"{n_broken} broken rows" if n_broken else "no total" if total is None else "rows differ from total" if n != total else None
        return name, n, len(opened[name].columns), total, problem

    return spark.createDataFrame([row(name) for name in sources], AUDIT)


def field_counts(rows: DataFrame, json: str = "json") -> DataFrame:
    """How many rows have each field, and whether it looks like a cost."""
    keys = rows.select(F.explode(row_fields(F.col(json))).alias("field"), cost_like_fields(F.col(json)).alias("costs"))
    return keys.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.array_contains("costs", F.col("field"))).alias("cost_like"))


def cost_fields(rows: DataFrame, json: str = "json") -> DataFrame:
    return field_counts(rows, json).filter("cost_like").select("field", "n")
