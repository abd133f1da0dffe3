"""The daily tally on a stream of items."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from storeops.functions.clock import ZONE, local_time
from storeops.functions.text import product_matches
from storeops.sources.documents import read_history, save_days, write_days
from storeops.sources.folders import Version, commit

#: Local time repeats an hour in autumn, and items come late.
LATENESS = "2 hours"
LATE = "run string, batch bigint, n_late bigint"


def daily_tally(items: DataFrame, word: str, cutoff: int | None = None, tz: str = ZONE) -> DataFrame:
    """Counts by local day and store of a stream (store_id, ts, productname), whatever the session's zone."""
    local = local_time(F.col("ts"), tz)
    rows = items if cutoff is None else items.filter(F.hour(local) < cutoff)
    # Watermarks need a timestamp: the instant at which UTC clocks show the local time.
    rows = rows.withColumn("local_ts", F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), local)))
    rows = rows.withWatermark("local_ts", LATENESS)
    counts = rows.groupBy(F.window("local_ts", "1 day").alias("day"), "store_id").agg(F.count_if(product_matches(F.col("productname"), word)).alias("n"))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("day.start") / 86_400).cast("int"))
    return counts.select(day.alias("date"), "store_id", "n")


def merge_into_history(spark: SparkSession, path: str):
    """A sink for update mode: a batch's rows replace those of their (date, store); whole days are written again, so a replay changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        new = batch.select("date", "store_id", "n").persist()

        def change(base: Version | None) -> dict[str, str]:
            if base is None:
                return write_days(new, path)
            old = read_history(spark, path, base).join(new.select("date").distinct(), "date", "left_semi")
            return base.parts | write_days(old.join(new, ["date", "store_id"], "left_anti").unionByName(new), path)

        try:
            commit(spark, path, change)
        finally:
            new.unpersist()

    return merge


def run_daily_tally(items: DataFrame, word: str, path: str, checkpoint: str, cutoff: int | None = None, tz: str = ZONE) -> None:
    """Works off what the stream has and upserts the history at ``path``."""
    query = daily_tally(items, word, cutoff, tz).writeStream.outputMode("update").foreachBatch(merge_into_history(items.sparkSession, path))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# Records that are saved once


def closing_tally(items: DataFrame, ticks: DataFrame, word: str, cutoff: int | None = None, tz: str = ZONE) -> DataFrame:
    """Counts by local day and store of a stream (id, store_id, ts, productname), given out once, when the day is over.

    A day is over when items or ``ticks`` (ts) have come that are LATENESS
    later than its end; ticks are the clock of an idle source and count
    nowhere. Items of days that are over are dropped. Copies of an item (id
    and day) count once. Rows of ticks come out with a null store.
    """
    local = local_time(F.col("ts"), tz)
    rows = items.filter("store_id is not null").select(F.col("id").cast("string").alias("id"), "store_id", "ts", "productname")
    rows = rows if cutoff is None else rows.filter(F.hour(local) < cutoff)
    none = [F.lit(None).cast("string").alias(c) for c in ("id", "store_id", "productname")]
    rows = rows.unionByName(ticks.select("ts", *none))
    rows = rows.withColumn("local_ts", F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), local)))
    rows = rows.withWatermark("local_ts", LATENESS).select("id", "store_id", "productname", F.window("local_ts", "1 day").alias("day"))
    # By item before anything is added up, so that what comes too late is counted by item.
    rows = rows.dropDuplicates(["id", "store_id", "day"])
    counts = rows.groupBy("day", "store_id").agg(F.count_if(product_matches(F.col("productname"), word)).alias("n"))
    return counts.select(F.date_from_unix_date(F.floor(F.unix_seconds("day.start") / 86_400).cast("int")).alias("date"), "store_id", "n")


class LateItems(StreamingQueryListener):
    """Collects, batch by batch, how many items the first operator with a watermark dropped, until the query ends."""

    def __init__(self):
        self.rows: list[tuple[str, int, int]] = []
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        # Operators come in the order from the sink to the sources; the one that is next to the sources sees items.
        late = progress.stateOperators[-1].numRowsDroppedByWatermark if progress.stateOperators else 0
        with self.news:
            self.rows.append((str(progress.runId), progress.batchId, late))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def of(self, run: str, seconds: float = 60) -> list[tuple[int, int]]:
        """(batch, items dropped) of a run that has ended; its events may still be on their way."""
        with self.news:
            if not self.news.wait_for(lambda: run in self.ended, seconds):
                raise TimeoutError(f"no word of the end of {run}")
            return [(batch, late) for r, batch, late in self.rows if r == run]


def run_closing_tally(items: DataFrame, ticks: DataFrame, word: str, path: str, checkpoint: str, audit: str | None = None, cutoff: int | None = None, tz: str = ZONE) -> None:
    """Works off what the streams have and saves each day that is over in the history at ``path``; a saved day never changes.

    The number of items that came too late is added to the table ``audit``
    (run, batch, n_late), a row for each batch that dropped some.
    """
    spark = items.sparkSession

    def save(batch: DataFrame, _: int) -> None:
        save_days(batch.filter("store_id is not null"), path)

    listener = LateItems()
    spark.streams.addListener(listener)
    try:
        query = closing_tally(items, ticks, word, cutoff, tz).writeStream.outputMode("append").foreachBatch(save)
        query = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        found = [(str(query.runId), batch, late) for batch, late in listener.of(str(query.runId)) if late]
    finally:
        spark.streams.removeListener(listener)
    if audit:
        spark.createDataFrame(found, LATE).write.mode("append").parquet(audit)
