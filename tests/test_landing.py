"""Versions of stored tables, landed pages, sources that break, layouts by store, audits."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from storeops.operators import sales
from storeops.sources import documents, folders, landing, pages
from storeops.sources.folders import DATA, Version, clean, commit, current, latest, publish, versions, work_folder


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(current(spark, path)).collect())


def test_the_last_of_two_writers_stays_and_the_other_is_kept(spark):
    path = work_folder(spark, "p")

    def slow(to):
        spark.range(1).write.parquet(to)
        publish(spark, path, spark.range(2).write.parquet)  # someone else, meanwhile

    publish(spark, path, slow)
    assert ids(spark, path) == [0] and versions(spark, path) == [1, 2]


def test_a_change_is_made_anew_on_what_another_writer_published(spark):
    path = work_folder(spark, "p")
    seen = []

    def change(base):
        seen.append(base)
        if base is None:
            commit(spark, path, lambda _: {"theirs": "x"})
        return (base.parts if base else {}) | {"mine": "y"}

    assert commit(spark, path, change) == Version(2, {"theirs": "x", "mine": "y"}) == latest(spark, path)
    assert [b and b.number for b in seen] == [None, 1]
    assert commit(spark, path, lambda _: None) is None and versions(spark, path) == [1, 2]


def test_many_writers_at_once_lose_nothing(spark):
    path, writers, each = work_folder(spark, "p"), 4, 8

    def write(k):
        return [commit(spark, path, lambda base, n=n: (base.parts if base else {}) | {f"{k}-{n}": "x"}).number for n in range(each)]

    with ThreadPoolExecutor(writers) as pool:
        numbers = [n for found in pool.map(write, range(writers)) for n in found]
    assert sorted(numbers) == list(range(1, writers * each + 1))
    assert set(latest(spark, path).parts) == {f"{k}-{n}" for k in range(writers) for n in range(each)}
    assert {n for n in folders._names(spark, f"{path}/{folders.VERSIONS}")} == {f"{n:012d}" for n in numbers}


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("step", ["in the data", "before the version", "before its name"])
def test_a_crash_leaves_the_old_or_nothing(spark, monkeypatch, step, first):
    path = work_folder(spark, "p")
    if not first:
        publish(spark, path, spark.range(3).write.parquet)

    def write(to):
        spark.range(9).write.parquet(to)
        if step == "in the data":
            raise RuntimeError("lost")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        if step == "before the version":
            m.setattr(folders, "_claim", lost)
        if step == "before its name":
            m.setattr(folders.json, "dumps", lost)  # when the file is there but empty
        publish(spark, path, write)
    if first:
        assert current(spark, path) is None and latest(spark, path) is None
        assert documents.read_log(spark, path, "id bigint").count() == 0
    else:
        assert ids(spark, path) == [0, 1, 2]
    publish(spark, path, spark.range(1).write.parquet)
    assert ids(spark, path) == [0]


def test_a_crash_before_the_first_history_leaves_none(spark, monkeypatch):
    path, rows = work_folder(spark, "h"), spark.createDataFrame([(1, "s0", 2)], "d int, store_id string, n bigint").selectExpr("date_from_unix_date(d) AS date", "store_id", "n")
    documents.write_days(rows, path)  # and then it ends
    with pytest.raises(FileNotFoundError):
        documents.read_history(spark, path)
    documents.upsert_history(rows, path)
    assert documents.read_history(spark, path).count() == 1
    documents.replace_history(rows.limit(0), path)
    assert documents.read_history(spark, path).collect() == []


def test_clean_up_keeps_what_a_version_or_nobody_names(spark):
    path = work_folder(spark, "p")
    for n in (1, 2, 3):
        publish(spark, path, spark.range(n).write.parquet)
    spark.range(4).write.parquet(f"{path}/{DATA}/v-unpublished")
    before = latest(spark, path)
    assert clean(spark, path, hours=1) == []
    assert len(clean(spark, path, hours=-1)) == 2 and versions(spark, path) == [3] and latest(spark, path) == before
    assert ids(spark, path) == [0, 1, 2] and spark.read.parquet(f"{path}/{DATA}/v-unpublished").count() == 4
    assert clean(spark, path, hours=-1) == []


def test_files_that_came_another_way_are_content(spark, tmp_path):
    (tmp_path / "log.json").write_text('[{"id": 1}]\n')
    at = tmp_path.as_uri()
    assert current(spark, at) == at and documents.read_log(spark, at, "id bigint").count() == 1
    documents.write_log(spark.createDataFrame([('[{"id": 5}]',)], "body string"), at)
    assert [r["id"] for r in documents.read_log(spark, at, "id bigint").collect()] == [5]


def test_landed_pages_and_rejects(spark, tmp_path):
    def land(endpoint, offset, text):
        at = tmp_path / f"endpoint={endpoint}" / f"offset={offset}"
        at.mkdir(parents=True)
        (at / "page.json").write_text(text)

    page = lambda rows, total: json.dumps({"data": rows, "paging": {"total": total}, "more": {"x": 1}}, indent=2)
    land("a", 0, page([{"id": 1, "name": "x"}, {"id": 2}], 5))
    land("a", 2, page([{"id": 3}, {"id": 3}], 5)[:60])
    land("a", 4, page([{"id": 5}], 5))
    land("b", 0, '{"data": null}')
    land("b", 1, " \n")
    land("b", 2, '{"data": {"id": 1}}')
    land("b", 3, '{"data": [{"id": "one"}], "paging": {"total": 1}}')
    found, rejects = landing.read_landed_pages(spark, str(tmp_path), "id:bigint,name:string")
    assert sorted(tuple(r) for r in pages.read_pages(found).collect()) == [("a", 1, "x"), ("a", 2, None), ("a", 5, None)]
    assert sorted((r["endpoint"], r["offset"], r["problem"], r["file"].endswith("/page.json")) for r in rejects.collect()) == [("a", 2, "broken", True), ("b", 1, "empty", True), ("b", 2, "broken", True), ("b", 3, "broken", True)]
    assert rejects.count() == 4 and found.select("offset").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        landing.read_landed_pages(spark, f"{tmp_path}/none", "id:bigint")


def test_landed_pages_are_bundled(spark, tmp_path):
    """Files don't grow with pages, and a bundle keeps each page's text as it came."""
    text = F.when(F.col("id") == 7, '{"data": [').when(F.col("id") == 8, "").otherwise(F.format_string('{"data":\n [{"id": %d}], "paging": {"total": 200}}', "id"))
    landing.write_landed_pages(spark.range(200).coalesce(2).select(F.concat(F.lit("e"), F.col("id") % 3).alias("endpoint"), F.col("id").alias("offset"), text.alias("text")), f"{tmp_path}/pages")
    assert len(list((tmp_path / "pages").rglob("part-*"))) == 2
    found, rejects = landing.read_landed_pages(spark, f"{tmp_path}/pages", "id:bigint", bundled=True)
    assert sorted((r["endpoint"], r["id"]) for r in pages.read_pages(found).collect()) == sorted((f"e{k % 3}", k) for k in range(200) if k not in (7, 8))
    assert sorted((r["endpoint"], r["offset"], r["problem"]) for r in rejects.collect()) == [("e1", 7, "broken"), ("e2", 8, "empty")]


SALE = "ts timestamp_ntz, amount decimal(18,2)"


def test_sources_that_break_are_left_out_whole(spark):
    good = spark.createDataFrame([(1,), (2,)], "amount int").withColumn("ts", F.lit("2024-01-02").cast("timestamp_ntz"))
    half = good.repartition(2).withColumn("amount", F.when(F.col("amount") == 2, F.raise_error(F.lit("cut off"))).otherwise(F.col("amount")))

    def refused():
        raise ConnectionError("refused\nagain")

    sources = {"s0": lambda: good, "s1": lambda: half, "s2": refused, "s3": lambda: good.withColumn("more", F.lit(1)), "s4": lambda: spark.read.parquet("/none/at/all")}
    dim = spark.createDataFrame([(f"s{k}", "x") for k in range(6)], "store_id string, name string")
    rows, audit = sales.sales_all_stores(sources, dim, 0, 1 << 40)
    assert sorted((r["store_id"], r["amount"], r["more"]) for r in rows.collect()) == [("s0", 1, None), ("s0", 2, None), ("s3", 1, 1), ("s3", 2, 1)]
    assert {r["store_id"]: r["problem"] for r in audit.collect()} == {"s1": "unreadable: USER_RAISED_EXCEPTION", "s2": "unreadable: refused", "s4": "unreadable: PATH_NOT_FOUND", "s5": "no source"}
    rows, audit = sales.sales_all_stores({"s2": refused}, dim, 0, 1 << 40)
    assert rows is None and audit.count() == 6


def test_a_tally_covers_the_stores_that_were_read(spark):
    one = spark.createDataFrame([("lemon",), ("other",)], "productname string")
    bad = one.withColumn("productname", F.raise_error(F.lit("x")).cast("string"))
    dim = spark.createDataFrame([("s0", "a"), ("s1", "b"), ("s2", "c")], "store_id string, name string")
    counts, audit = sales.tally_all_stores({"s0": lambda: one, "s1": lambda: bad, "s2": lambda: one.limit(0)}, dim, "lemon")
    assert {r["store_id"]: r["n"] for r in counts.collect()} == {"s0": 1, "s2": 0, None: 1} and [r["store_id"] for r in audit.collect()] == ["s1"]


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_layout_by_store_is_pruned(spark):
    path = work_folder(spark, "l")
    rows = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 5).alias("store_id"), F.timestamp_micros(F.col("id") * 10**9).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).cast("decimal(18,2)").alias("amount"))
    landing.lay_out(rows, path)
    laid = landing.read_laid_out(spark, path, f"{SALE}, store_id string")
    one = sales.sales_range(laid, "s2", 0, 1 << 40)
    assert one.count() == 200 and "PartitionFilters: [isnotnull(store_id" in plan(one)
    assert {f.split("store_id=")[1].split("/")[0] for f in laid.filter("store_id = 's2'").inputFiles()} >= {"s2"}
    dims = work_folder(spark, "d")
    spark.createDataFrame([(f"s{k}", f"Store {k}") for k in range(5)], "store_id string, name string").write.parquet(dims)
    some = sales.sales_of_stores(laid, spark.read.parquet(dims).filter("name = 'Store 4'"))
    assert some.count() == 200
    assert "dynamicpruning" in plan(some)


def test_audit_reads_sources_with_one_plan(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 nonsense")

    def fails():
        raise ValueError("no such store\nat all")

    ok = {f"g{k}": (lambda k=k: spark.range(k)) for k in range(4)} | {"map": lambda: spark.range(2).select(F.create_map("id", "id").alias("m"))}
    tracker = spark.sparkContext.statusTracker()

    def jobs(sources):
        spark.sparkContext.setJobGroup("audit", "audit")
        before = len(tracker.getJobIdsForGroup("audit"))
        found = pages.audit_sources(spark, sources, {"g3": 3, "g2": 3})
        return {r["source"]: (r["n_rows"], r["problem"]) for r in found.collect()}, len(tracker.getJobIdsForGroup("audit")) - before

    few, n = jobs({k: ok[k] for k in ("g2", "g3")})
    assert few == {"g2": (2, "rows differ from total"), "g3": (3, None)}
    many, m = jobs(ok)
    assert many == {"g0": (0, "no total"), "g1": (1, "no total"), "g2": (2, "rows differ from total"), "g3": (3, None), "map": (2, "no total")} and m <= n + 1
    odd = {"bad": lambda: spark.read.schema("id bigint").parquet(str(tmp_path)), "gone": lambda: spark.read.parquet(f"{tmp_path}/none"), "odd": fails}
    found, _ = jobs(ok | odd)
    assert found.pop("bad")[1].startswith("unreadable: ")
    assert found == many | {"gone": (None, "unreadable: PATH_NOT_FOUND"), "odd": (None, "unreadable: no such store")}
    (tmp_path / "rows.json").write_text('{"id": 1}\nnonsense\n')
    lines = lambda: spark.read.schema(f"id bigint, {pages.BROKEN} string").json(f"{tmp_path}/rows.json")
    assert jobs({"lines": lines})[0] == {"lines": (2, "1 broken rows")}
