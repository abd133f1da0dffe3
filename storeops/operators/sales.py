"""Stores, sales over ranges and days, and the daily product tally."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeops.functions.clock import ZONE, local_date, local_midnight, local_time
from storeops.functions.text import folded, product_matches
from storeops.sources.landing import land_sources


def list_stores(store_dim: DataFrame) -> DataFrame:
    return store_dim.select("store_id", "name")


def resolve_store(df: DataFrame, store_dim: DataFrame, raw: str = "raw") -> DataFrame:
    """With ``store_id``: that of the same spelling, else that of the folded spelling, else null. The dimension has a few rows."""
    ids = store_dim.select("store_id")
    exact = df.join(F.broadcast(ids.withColumnRenamed("store_id", "exact_id")), F.col(raw) == F.col("exact_id"), "left")
    both = exact.join(F.broadcast(ids.withColumnRenamed("store_id", "folded_id")), folded(F.col(raw)) == F.col("folded_id"), "left")
    return both.withColumn("store_id", F.coalesce("exact_id", "folded_id")).drop("exact_id", "folded_id")


def unknown_store_rejects(df: DataFrame, store_dim: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows whose store can't be resolved."""
    return resolve_store(df, store_dim, raw).filter("store_id is null").drop("store_id")


def between(ts: Column, lo: int, hi: int) -> Column:
    """Unix seconds from lo up to but not including hi; on the timestamp itself, so that it reaches the scan."""
    at = lambda s: F.timestamp_add("SECOND", F.lit(s), F.lit("1970-01-01").cast("timestamp_ntz"))
    return (ts >= at(lo)) & (ts < at(hi))


def sales_range(sales: DataFrame, store_id: str, lo: int, hi: int) -> DataFrame:
    return sales.filter((F.col("store_id") == store_id) & between(F.col("ts"), lo, hi))


def sales_all_stores(sources: dict[str, Callable[[], DataFrame]], store_dim: DataFrame, lo: int, hi: int) -> tuple[DataFrame | None, DataFrame]:
    """(rows of all stores whose source could be read to the end, tagged by store; the other stores with the problem)."""
    ranged = {store: (lambda open_=open_: open_().filter(between(F.col("ts"), lo, hi))) for store, open_ in sources.items()}
    return of_stores(ranged, store_dim)


def of_stores(sources: dict[str, Callable[[], DataFrame]], store_dim: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(rows of the stores' sources, audit of the stores that have none or whose source broke)."""
    rows, failed = land_sources(store_dim.sparkSession, sources)
    without = store_dim.filter(~F.col("store_id").isin(*sources)).select("store_id", F.lit("no source").alias("problem"))
    return rows, without.unionByName(failed.withColumnRenamed("source", "store_id"))


def tally_all_stores(sources: dict[str, Callable[[], DataFrame]], store_dim: DataFrame, word: str) -> tuple[DataFrame, DataFrame]:
    """(counts by store and in total, audit): stores whose source broke are left out, also of the total; those that were read count 0 at least."""
    rows, audit = of_stores(sources, store_dim)
    read = store_dim.join(F.broadcast(audit), "store_id", "left_anti")  # a row for each of a few stores
    items = store_dim.select("store_id", F.lit(None).cast("string").alias("productname")).limit(0) if rows is None else rows
    return tally_by_store(items, read, word), audit


def sales_of_stores(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Sales of the stores of a table, which has a row for each of a few; where sales are laid out by store, only those stores are read."""
    return sales.join(F.broadcast(stores.select("store_id")), "store_id", "left_semi")


def item_sales_for_day(items: DataFrame, store_id: str, day: str, tz: str = ZONE) -> DataFrame:
    """Items of a store on a local day; the bounds are instants, so the filter reaches the scan."""
    start = F.lit(day).cast("date")
    inside = (F.col("ts") >= local_midnight(start, tz)) & (F.col("ts") < local_midnight(F.date_add(start, 1), tz))
    return items.filter((F.col("store_id") == store_id) & inside)


def tally(items: DataFrame, word: str, *keys: Column) -> DataFrame:
    """Rows whose product holds the word, by keys; groups without such rows count 0."""
    return items.groupBy(*keys).agg(F.count_if(product_matches(F.col("productname"), word)).alias("n"))


def zero_filled(counts: DataFrame, stores: DataFrame) -> DataFrame:
    """A row for each of ``stores``, 0 where it has no count."""
    return stores.select("store_id").join(counts, "store_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def tally_by_store(items: DataFrame, store_dim: DataFrame, word: str) -> DataFrame:
    """Counts by store and in total (store_id null); stores without items count 0."""
    counts = zero_filled(tally(items, word, F.col("store_id")), store_dim)
    return counts.rollup("store_id").agg(F.sum("n").alias("n"), F.grouping("store_id").cast("int").alias("is_total"))


def nested(counts: DataFrame) -> DataFrame:
    """(date, stores, total) from (date, store_id, n): the tidy form as one map for each day, keys in order."""
    entries = F.array_sort(F.collect_list(F.struct("store_id", "n")))
    return counts.groupBy("date").agg(F.map_from_entries(entries).alias("stores"), F.sum("n").alias("total"))


def tally_today(items: DataFrame, store_dim: DataFrame, word: str, day: str, tz: str = ZONE) -> DataFrame:
    """The day's record as of now, late items included."""
    start = F.lit(day).cast("date")
    inside = (F.col("ts") >= local_midnight(start, tz)) & (F.col("ts") < local_midnight(F.date_add(start, 1), tz))
    counts = zero_filled(tally(items.filter(inside), word, F.col("store_id")), store_dim)
    return nested(counts.withColumn("date", start))


def tally_until_cutoff(items: DataFrame, word: str, cutoff: int = 22, tz: str = ZONE) -> DataFrame:
    """Counts by local day and store of items before the cutoff hour."""
    early = items.filter(F.hour(local_time(F.col("ts"), tz)) < cutoff)
    return tally(early, word, local_date(F.col("ts"), tz).alias("date"), F.col("store_id"))


