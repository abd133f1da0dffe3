"""A corpus from raw documents to tokens: the stages of the training-data pipeline in order.

``run`` applies the stages to the table ``documents``. Each stage is written
to the shared folder and read again, so that it judges its own input, all
that its predecessor kept, and a lost executor costs no more than its stage.

Every stage but the last judges rows, not ids, and returns the columns of its
input: rows that share an id but not their text are judged apart, equal rows
alike, and rows without id always stay where a stage looks for copies. Null,
empty and blank texts are clean, and copies of one another (blank ones by
their deleted white space). Texts of any length are taken whole; an empty
table gives an empty table; further columns of the table are carried along,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm import bpe, decontam, exact_dedup, minhash, toxicity
from storeops.llm.shared import Scratch, table

#: Words of a shingle, and the share of hit words from which on a document is a copy of test items.
SHINGLE, MOST_SHARE = 5, 0.5


def rest_of_row(docs: DataFrame) -> Column:
    """The columns beside the text, so that workers get each text once."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))


def without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose id and text hash are among ``dropped``; these are written first, so that few of them spare the texts a shuffle."""
    gone = Scratch(docs.sparkSession, name).write(dropped.select("doc_id", "text_hash").distinct(), "dropped")
    return docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"]), "left_anti")


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rows whose texts are predicted to be toxic; labels of held-out ids aren't learned from."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    index = toxicity.fit(docs, labels)
    found = toxicity.score(docs.select(rest_of_row(docs).alias("row"), "text"), index, id_col="row", keep_text=True)
    return found.filter("predicted = 0").select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def clean_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    found = exact_dedup.exact_dedup(docs)
    return without(docs, found.filter("not kept and doc_id is not null"), "copies")


def clean_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 or more of their 5-word shingles shared."""
    found = minhash.near_dedup(docs, words=SHINGLE, percent=80)
    return without(docs, found.filter("not kept"), "near")


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items cut out; documents that are mostly such passages go. Texts that change get a new n_chars."""
    out = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), most_share=MOST_SHARE, least_words=1)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: the ids of its text, and digests of the ids and of the bytes they stand for; a null text has no ids."""
    encoded = bpe.encode(docs, decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", clean_toxicity),
    ("exact_dedup", clean_copies),
    ("near_dedup", clean_near_copies),
    ("decontamination", clean_benchmark),
    ("bpe", tokens),
]

#: SQL can't express the stages; tests hold the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.release(STAGES[k - 1][0])
    return docs
