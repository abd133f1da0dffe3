"""The pipeline's stages against brute force on the smallest tables, and the queries with SQL."""

import hashlib
import re

import numpy as np
import pytest
from conftest import DATA
from oracle import connect, same
from pyspark.sql import functions as F
from test_operators import hits, near_groups

import corpus_pipeline
from storeops.llm import bpe, queries, toxicity
from storeops.llm.shared import Scratch, table

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


def test_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES if n != "pipeline"} == {str(k) for k in range(1, 14)}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_equal_brute_force(spark):
    scratch = Scratch(spark, "t")
    docs = table(spark, SF, "documents")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]

    labels = table(spark, SF, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 1").collect()}
    a = scratch.write(stages["toxicity"](spark, docs, SF), "a")
    assert a.columns == columns and toxic
    kept = {i: t for i, t in texts(docs).items() if i not in toxic}
    assert texts(a) == kept

    b = scratch.write(stages["exact_dedup"](spark, a, SF), "b")
    groups: dict = {}
    for i, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    kept = {i: kept[i] for g in groups.values() for i in [min(g, key=lambda i: (-len(kept[i] or ""), i))]}
    assert b.columns == columns and texts(b) == kept

    c = scratch.write(stages["near_dedup"](spark, b, SF), "c")
    groups = near_groups(list(kept.items()), corpus_pipeline.SHINGLE)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    assert c.columns == columns and texts(c) == kept

    d = scratch.write(stages["decontamination"](spark, c, SF), "d")
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    found = {i: (n, h) for i, n, h, _ in hits(list(kept.items()), items, 10)}
    left = texts(d)
    assert d.columns == columns
    assert set(left) == {i for i, (n, h) in found.items() if not h or h <= 0.5 * n}
    assert {i: t for i, t in left.items() if not found[i][1]} == {i: t for i, t in kept.items() if not found[i][1]}
    assert all(h == 0 for _, _, h, _ in hits(list(left.items()), items, 10))
    assert all(len(left[i].split()) > 0 and len(left[i]) < len(kept[i]) for i in left if found[i][1])

    enc = bpe.encoding()
    want = {i: (len(x := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in left.items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["bpe"](spark, d, SF).collect()} == want
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == {i: w[1] for i, w in want.items()}


def test_stages_judge_rows_and_carry_all_columns(spark):
    """Ids that stand on several texts, and columns whose names an operator might use or no DDL string could hold."""
    rows = [(1, "same text here of some words"), (2, "same text here of some words"), (2, "another unique text that nobody has"), (3, "another  unique text that nobody has"), (None, "same text here of some words"), (2, None), (4, "")]
    extra = ["row", "id", "text_hash", "meta-data", "a.b", "tie", "kept"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *(f"{k}{c}" for c in extra)) for k, (i, t) in enumerate(rows)], ["doc_id", "text", "lang", "source", "n_chars", *extra]).withColumn("doc_id", F.col("doc_id").cast("bigint")).repartition(3)
    told = lambda df: sorted(((r["doc_id"], r["text"], r["a.b"]) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    all_rows = [(i, t, f"{k}a.b") for k, (i, t) in enumerate(rows)]
    want = {"toxicity": all_rows, "exact_dedup": [all_rows[k] for k in (0, 3, 4, 5)], "near_dedup": [all_rows[k] for k in (0, 2, 4, 5, 6)], "decontamination": all_rows}
    for name, kept in want.items():
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns and told(out) == sorted(kept, key=str), name
    assert stages["bpe"](spark, docs, SF).count() == len(rows)


def test_stages_take_odd_tables(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "", "en", "s", 0), (None, "x y", None, None, 3), (4, "z" * 20_000, "en", "s", 20_000), (4, "z" * 20_000, "en", "s", 20_000)], docs.schema)
    scratch = Scratch(spark, "t")
    for rows, want in ((odd, {None, 1, 4}), (odd.limit(0), set())):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = scratch.write(stage(spark, rows, SF), f"{k}-{len(want)}")
        assert {r["doc_id"] for r in rows.collect()} == want
