"""Operator 5: exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one
row for each of its digests before it is shuffled, so copies never meet in one
task; a sort-merge anti-join against the index (whose side needs no exchange)
leaves the new digests, and those are appended. What a batch saw of digests
that were there already is appended too, as sightings: the row that stays and
the size of a group follow from all its rows, one for each batch that had the
text. The number of buckets follows the number of digests that the index is
made for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm.shared import WHITE, Scratch, table

#: Digests of a bucket, about, and buckets that an index has at least and at most.
BUCKET_ROWS, BUCKETS, MOST_BUCKETS = 2_000_000, 16, 8_192
INDEX_SCHEMA = "digest binary, has_id boolean, n_points int, minus_id bigint, n bigint, new boolean, batch string"
#: Batches in which a table is taken into an index of its own.
BATCHES = 2


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, n_points, text_hash): SHA-256 of the normalised text, code points and xxhash64 of the original."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"),
        F.xxhash64(text_col).alias("text_hash"),
    )


def buckets_for(digests: int) -> int:
    """A power of two, so that a later index of twice the buckets splits each of them."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << max(0, -(-digests // BUCKET_ROWS) - 1).bit_length()))


class DigestIndex:
    """A persistent set of digests in a bucketed, sorted table.

    It lies at ``path`` and outlives the session: where the catalog doesn't
    know the table, it is declared over the files that are there. A bucket
    holds one row for each digest, so its size follows the number of distinct
    texts and no group of copies. ``buckets`` is fixed when the index is made;
    :func:`buckets_for` tells how many suit a number of digests.

    One batch is taken in at a time: two that are taken in at once could both
    append a digest that neither finds. A batch that is taken in once more
    counts once more.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def _append(self, rows: DataFrame) -> None:
        writer = rows.repartition(self.buckets, "digest").write.format("parquet").mode("append")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)

    def drop(self) -> None:
        """Forgets the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, marked: DataFrame, batch: str) -> None:
        """Appends a row for each digest of ``marked`` (see :func:`digests`): new ones and sightings of those that the index has."""
        best = F.max(F.struct(F.col("id").isNotNull().alias("has_id"), "n_points", (-F.col("id")).alias("minus_id")))
        seen = marked.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select("digest", "best.*", "n")
        known = self.rows().filter("new").select("digest").hint("merge")
        new, old = seen.join(known, "digest", "left_anti"), seen.join(known, "digest", "left_semi")
        self._append(new.withColumn("new", F.lit(True)).unionByName(old.withColumn("new", F.lit(False))).withColumn("batch", F.lit(batch)))

    def groups(self) -> DataFrame:
        """(digest, keep_id, group_size) of all texts taken in so far; a bucket is read by one task and needs no exchange."""
        best = F.max(F.struct("has_id", "n_points", "minus_id"))
        found = self.rows().groupBy("digest").agg(best.alias("best"), F.sum("n").alias("group_size"))
        return found.select("digest", (-F.col("best.minus_id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, text_hash (xxhash64 of the text).

    Texts are equal when they are identical after all characters of
    ``[\\x20\\x09-\\x0D]`` are deleted; a null text counts as empty, so nulls and
    blank texts form one group. Ties go to the smallest id. Repeated rows with
    one id are all kept when that id is kept. A row without id never wins
    against a row with one; a group of such rows alone has keep_id null and
    kept false. An empty table gives an empty result. Other columns of
    ``docs`` are not looked at. Digests are made where the texts are read and
    no text is exchanged, so very long ones are no special case.

    ``keep_id`` and ``group_size`` are those of all batches that ``index`` has
    taken in, this one included; the row that stays may be an earlier one.
    Without ``index`` a new one is made, with buckets for as many digests as
    ``docs`` has rows, takes ``docs`` in by batches, and is left out of the
    catalog again.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "digests")
    marked = scratch.write(digests(docs, id_col, text_col), "marked")
    own = index is None
    if index is None:
        index = DigestIndex(spark, scratch.root.rsplit("/", 1)[1].replace("-", "_"), scratch.path("index"), buckets_for(marked.count()))
    if own:
        # Copies fall into different batches, so that the later ones meet the earlier in the index.
        for k in range(BATCHES):
            index.ingest(marked.filter(F.pmod(F.xxhash64("id", "text_hash"), F.lit(BATCHES)) == k), f"{batch}-{k}")
    else:
        index.ingest(marked, batch)
    # As a table of its own, so that both sides of the join are exchanged and Spark can split a hot digest.
    entries = scratch.write(index.groups(), "groups")
    if own:
        index.drop()
    found = marked.drop("n_points").join(entries, "digest")
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS kept,
       h AS text_sha256
FROM d
"""
