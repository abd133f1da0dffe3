"""Recipe documents, logs and the tally history, at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.operators.recipes import DOCUMENT, migrate_recipes, recipes_changed
from storeops.sources.folders import DATA, Version, commit, current, folders, latest, new_data, publish

HISTORY = "date date, store_id string, n bigint"
NESTED = "date date, stores map<string,bigint>, total bigint"


def read_recipes(spark: SparkSession, path: str, default: DataFrame, whole: bool = False) -> DataFrame:
    """The recipe documents at ``path``, or ``default`` if there are none; one that can't be parsed raises.

    A document is a line, or with ``whole`` a file.
    """
    at = current(spark, path)
    return read_documents(spark, at, whole) if at else default


def read_documents(spark: SparkSession, at: str, whole: bool = False) -> DataFrame:
    """The recipe documents of one folder or file."""
    text = spark.read.text(at, wholetext=whole)
    return text.select(F.from_json("value", DOCUMENT, {"mode": "FAILFAST"}).alias("doc"))


def write_recipes(docs: DataFrame, path: str) -> None:
    """Replaces the document; it may have been read from the same path."""
    publish(docs.sparkSession, path, lambda at: write_documents(docs, at))


def write_documents(docs: DataFrame, at: str) -> None:
    """A line for each document in a new folder, compressed: keys and names recur in each recipe, and a replaced version stays until it is cleaned away."""
    # Hadoop's setting for its gzip: the default level halves the speed of the job for a quarter less.
    docs.select(F.to_json("doc").alias("value")).write.option("zlib.compress.level", "BEST_SPEED").text(at, compression="gzip")


def migrate_stored(spark: SparkSession, path: str, dishes: dict[str, str], ingredients: dict[str, str]) -> bool:
    """Renames dishes and ingredients in the documents at ``path``; whether there was anything to write. Where there are none, nothing is made.

    If someone else publishes meanwhile, the job works on what they published.
    """

    def change(_: Version | None) -> dict[str, str] | None:
        at = current(spark, path)
        docs = read_documents(spark, at) if at else None
        if docs is None or not recipes_changed(docs, dishes, ingredients).first()["changed"]:
            return None
        name = new_data()
        write_documents(migrate_recipes(docs, dishes, ingredients), f"{path}/{DATA}/{name}")
        return {"": name}

    return commit(spark, path, change) is not None


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of the log's arrays, an array in each line, or none if there is no log."""
    at = current(spark, path)
    return spark.read.schema(schema).json(at) if at else spark.createDataFrame([], schema)


def is_array(body: Column) -> Column:
    """Whether a text is a JSON array; false for malformed text and null."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("ARRAY"), F.lit(False))


def write_log(bodies: DataFrame, path: str) -> DataFrame:
    """Replaces the log by the bodies that are arrays and returns the others."""
    publish(bodies.sparkSession, path, bodies.filter(is_array(F.col("body"))).select("body").write.text)
    return bodies.filter(~is_array(F.col("body")))


def history_rows(nested: DataFrame) -> DataFrame:
    """(date, store_id, n) from (date, stores, total)."""
    return nested.select("date", F.explode("stores").alias("store_id", "n"))


def read_nested_history(spark: SparkSession, path: str) -> DataFrame:
    """The tidy form of a history of JSON records (date, stores by id, total), a record in each line; a missing or broken one raises."""
    return history_rows(spark.read.schema(NESTED).option("mode", "FAILFAST").json(path))


def read_history(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The tidy history as of one version, the last by default; a missing or broken one raises.

    A version names a folder for each day, so a reader keeps the state that it
    began with, whatever is published meanwhile.
    """
    version = version or latest(spark, path)
    if version is None:
        raise FileNotFoundError(f"no history at {path}")
    if not version.parts:
        return spark.createDataFrame([], HISTORY)
    days = [f"{path}/{DATA}/{at}" for at in version.parts.values()]
    return spark.read.schema(f"{HISTORY}, batch string").option("basePath", f"{path}/{DATA}").parquet(*days).select("date", "store_id", "n")


def write_days(rows: DataFrame, path: str) -> dict[str, str]:
    """Writes a new folder for each day of ``rows`` below the history at ``path``, published by none yet: day to folder."""
    spark, batch = rows.sparkSession, new_data()
    # Dealt by day, so that each day's folder gets one file; a day has a row for each store.
    tidy = rows.select("date", "store_id", "n", F.lit(batch).alias("batch")).repartition("date")
    tidy.write.mode("append").partitionBy("date", "batch").parquet(f"{path}/{DATA}")
    made = folders(spark, f"{path}/{DATA}/date=*/batch={batch}")
    return {(day := at.rsplit("/", 2)[1]): f"{day}/batch={batch}" for at in made}


def replace_history(rows: DataFrame, path: str) -> None:
    new = write_days(rows, path)
    commit(rows.sparkSession, path, lambda _: new)


def upsert_history(updates: DataFrame, path: str) -> None:
    """Puts the days of ``updates`` in the place of those days; others stay, also those that others publish meanwhile. Doing it twice is doing it once."""
    new = write_days(updates, path)
    commit(updates.sparkSession, path, lambda base: (base.parts if base else {}) | new)


def save_days(rows: DataFrame, path: str) -> None:
    """Adds the days of ``rows`` that the history doesn't have; a day that was saved never changes."""
    new = write_days(rows, path)
    commit(rows.sparkSession, path, lambda base: new | base.parts if base else new)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The history after an upsert, as a query."""
    return old.join(new.select("date").distinct(), "date", "left_anti").unionByName(new)
