"""Pages, recipes, logs, history, invoices and streams on small cases."""

import gzip
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest
from oracle import same
from pyspark.sql import functions as F

from storeops.operators import invoices, recipes, sales
from storeops.plans import bindings, catalog
from storeops.sources import documents, pages
from storeops.sources.folders import current, work_folder
from storeops.streaming.tally import run_closing_tally, run_daily_tally

PAGE = "endpoint string, offset bigint, data array<struct<id:bigint>>, paging struct<total:bigint>"


def test_page_stop_rules(spark):
    row = lambda e, o, ids, total: (e, o, None if ids is None else [(i,) for i in ids], (total,))
    rows = [row("full", 0, [1, 2], 3), row("full", 2, [3], 3), row("full", 3, [9], 3), row("none", 0, [1], None), row("none", 1, [2], None), row("gap", 0, [1], 5), row("gap", 1, [], 5), row("gap", 1_000, [2], 5), row("null", 0, None, 5), row("twice", 0, [1, 1], 2)]
    found = pages.read_pages(spark.createDataFrame(rows, PAGE)).collect()
    assert sorted(map(tuple, found)) == [("full", 1), ("full", 2), ("full", 3), ("gap", 1), ("none", 1), ("twice", 1), ("twice", 1)]


DISHES = {"Gulerodssuppe": "Carrot soup"}
INGREDIENTS = {"Gulerod": "Carrot", "Piskefløde": "Cream", "Fløde": "Cream"}


def docs(spark):
    one = {"a": ("Gulerodssuppe", 1.0, 2.0, [("Gulerod", 1.0), ("Piskefløde", 2.0), ("Fløde", 3.0)]), "b": ("Other", 1.0, 2.0, None)}
    return spark.createDataFrame([(one,)], f"doc {recipes.DOCUMENT}")


def test_migration_keeps_all_else_and_is_idempotent(spark):
    once = recipes.migrate_recipes(docs(spark), DISHES, INGREDIENTS)
    doc = once.first()["doc"]
    assert doc["a"]["name"] == "Carrot soup" and [i["name"] for i in doc["a"]["ingredients"]] == ["Carrot", "Cream", "Cream"]
    assert [i["grams"] for i in doc["a"]["ingredients"]] == [1, 2, 3] and doc["b"]["ingredients"] is None and doc["b"]["name"] == "Other"
    assert recipes.migrate_recipes(once, DISHES, INGREDIENTS).first() == once.first()
    assert recipes.recipes_changed(docs(spark), DISHES, INGREDIENTS).first()["changed"]
    assert not recipes.recipes_changed(once, DISHES, INGREDIENTS).first()["changed"]


def test_recipes_at_rest(spark, tmp_path):
    path = work_folder(spark, "r")
    assert documents.read_recipes(spark, path, docs(spark)).first()["doc"]["b"]["name"] == "Other"
    documents.write_recipes(docs(spark), path)
    assert documents.read_recipes(spark, path, docs(spark).limit(0)).first() == docs(spark).first()
    (tmp_path / "bad.json").write_text("{nonsense")
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        documents.read_recipes(spark, str(tmp_path / "bad.json"), docs(spark), whole=True).collect()


def test_migration_writes_only_if_something_changed(spark):
    path = work_folder(spark, "m")
    assert not documents.migrate_stored(spark, path, DISHES, INGREDIENTS)
    documents.write_recipes(docs(spark), path)
    first = current(spark, path)
    assert documents.migrate_stored(spark, path, DISHES, INGREDIENTS)
    second = current(spark, path)
    assert not documents.migrate_stored(spark, path, DISHES, INGREDIENTS)
    assert first != second == current(spark, path)
    assert documents.read_recipes(spark, path, docs(spark)).first()["doc"]["a"]["name"] == "Carrot soup"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recipes_are_collected_behind_one_exchange(spark, tmp_path):
    """No list is held where lines are scanned, and none is exchanged; parts without lines and lines without parts make no recipe."""
    parts = [(k, f"part {k}", k, 1.5) for k in range(45)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k * 1000, k % 50, float(k % 9), "AN"[k % 2], "FO"[k % 3 % 2]) for k in range(400) if k % 50 not in (3, 44)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for order, part, grams, flag, status in lines:
        if part < 45:
            want.setdefault((f"{part}-{order // 100_000}", f"part {part}", part, 1.5), []).append((flag + status, grams))
    for held in (7, 1_000_000):
        docs = bindings.recipes(spark, str(tmp_path), held)
        assert {tuple(r)[:4]: list(map(tuple, r["ingredients"])) for r in recipes.recipes_flatten(docs).collect()} == {k: sorted(v) for k, v in want.items()}
        plan = planned(docs)
        assert 0 < plan.rfind("collect_list") < plan.find("Exchange hashpartitioning")
    assert docs.rdd.getNumPartitions() == 1 and bindings.recipes(spark, str(tmp_path), 100).rdd.getNumPartitions() == 4


def shuffled(plan):
    """(partitioning, rows) of the exchanges of a plan that ran."""
    name = plan.nodeName()
    if "QueryStage" in name or name == "AdaptiveSparkPlan":
        return shuffled(plan.plan() if "QueryStage" in name else plan.executedPlan())
    mine = [(plan.toString().split("\n")[0], plan.metrics().get("shuffleRecordsWritten").get().value())] if name == "Exchange" else []
    return mine + [x for k in range(plan.children().size()) for x in shuffled(plan.children().apply(k))]


def recipe_tables(spark, at, lines, parts):
    """Lines are (order, part)."""
    spark.createDataFrame([(k, f"part {k}", k, 1.5) for k in range(parts)], "p_partkey bigint, p_name string, p_size int, p_retailprice double").write.parquet(f"{at}/part.parquet")
    rows = [(order, part, float(order % 9), "AN"[part % 2], "FO"[order % 3 % 2]) for order, part in lines]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{at}/lineitem.parquet")


def test_heads_of_recipes_are_dealt_once(spark, tmp_path):
    """Parts with lines in many stretches of orders: a head is not repeated for each of them."""
    lines = [(k * 100_000 + part, part) for part in range(40) for k in range(part % 7, 50, 7)]
    recipe_tables(spark, tmp_path, lines, 40)
    docs = bindings.recipes(spark, str(tmp_path), 2_000)
    found = [(key, value["name"]) for row in docs.collect() for key, value in row["doc"].items()]
    assert sorted(found) == sorted((f"{part}-{order // 100_000}", f"part {part}") for order, part in lines)
    dealt = [n for how, n in shuffled(docs._jdf.queryExecution().executedPlan()) if "REPARTITION_BY_NUM" in how]
    assert dealt == [len(lines) + 40]


def test_lines_of_frequent_parts_are_dealt_by_stretch(spark, tmp_path):
    """A few parts with many lines for a task go to several, each with their heads; the others aren't parted."""
    lines = [(k * 1_000, 3) for k in range(2_000)] + [(k, 20 + k % 20) for k in range(60)]
    recipe_tables(spark, tmp_path, lines, 60)
    docs = bindings.recipes(spark, str(tmp_path), 500)
    rows = [(key, value["name"], len(value["ingredients"])) for row in docs.collect() for key, value in row["doc"].items()]
    assert sorted(rows) == sorted([(f"3-{k}", "part 3", 100) for k in range(20)] + [(f"{20 + k}-0", f"part {20 + k}", 3) for k in range(20)])
    dealt = [n for how, n in shuffled(docs._jdf.queryExecution().executedPlan()) if "REPARTITION_BY_NUM" in how]
    assert dealt == [2_060 + 32 * 20 + 40]  # the heads of the first 20 parts go with each of their shares
    sizes = docs.rdd.glom().map(len).collect()
    assert len(sizes) == 5 and sum(n > 0 for n in sizes) > 3


def test_documents_do_not_grow_with_lines(spark, tmp_path):
    """Parts with lines in a stretch or two share a document, those with many stretches have several."""
    lines = [(k * 20_000, k % 5) for k in range(6_000)] + [(k * 1_000, 20 + k % 20) for k in range(200)]
    recipe_tables(spark, tmp_path, lines, 40)
    found = [{k: len(v["ingredients"]) for k, v in row["doc"].items()} for row in bindings.recipes(spark, str(tmp_path)).collect()]
    assert {k: n for doc in found for k, n in doc.items()} == dict(Counter(f"{part}-{order // 100_000}" for order, part in lines))
    assert sorted(sum(doc.values()) for doc in found) == [200] + 6 * [1_000]


def stored(at):
    """(files, their bytes) of the last version."""
    files = [f for f in Path(at.removeprefix("file:")).iterdir() if f.name.startswith("part-")]
    return files, sum(f.stat().st_size for f in files)


def test_written_documents_are_compressed(spark):
    path = work_folder(spark, "small")
    recipe = F.struct(F.concat(F.lit("dish "), F.col("id") % 20).alias("name"), F.lit(1.0).alias("defaultPortion"), F.lit(900.0).alias("batchSize"), F.array(F.struct(F.lit("AF").alias("name"), (F.col("id") % 50).cast("double").alias("grams"))).alias("ingredients"))
    many = spark.range(5_000).select(F.create_map(F.concat_ws("-", F.col("id"), F.lit(7)), recipe).cast(recipes.DOCUMENT).alias("doc"))
    text = many.select(F.sum(F.octet_length(F.to_json("doc")))).first()[0]
    documents.write_recipes(many, path)
    documents.write_recipes(documents.read_recipes(spark, path, docs(spark)), path)  # over what is being read
    files, size = stored(current(spark, path))
    assert 0 < size < text / 5 and all(f.name.endswith(".txt.gz") for f in files)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(documents.read_recipes(spark, path, docs(spark))) == order(many)


def test_migrated_documents_are_compressed(spark):
    path = work_folder(spark, "renamed")
    documents.write_recipes(docs(spark), path)
    assert documents.migrate_stored(spark, path, DISHES, INGREDIENTS)
    files, size = stored(current(spark, path))
    assert size and all(f.name.endswith(".txt.gz") for f in files)


@pytest.mark.parametrize("held", [200, 500_000])
def test_stored_recipes_of_many_stretches(spark, tmp_path, monkeypatch, held):
    """Orders and parts that don't depend on each other, so that most lines are a recipe of their own: rows as by SQL, and what is stored is a small share of the text."""
    import random

    rng = random.Random(5)
    recipe_tables(spark, tmp_path, [(rng.randrange(6_000_000), 7 if rng.random() < 0.1 else rng.randrange(430)) for _ in range(6_000)], 400)
    monkeypatch.setattr(bindings.recipes, "__defaults__", (held,))
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("write_recipes", "migrate_recipes_twice", "migrate_recipes"):
        shared = Path(work_folder(spark, "x").removeprefix("file:")).parent
        others = set(shared.iterdir())
        same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])
        (made,) = set(shared.iterdir()) - others
        files = list(made.glob("_data/*/part-*"))
        size = sum(f.stat().st_size for f in files)
        text = sum(len(gzip.decompress(f.read_bytes())) if f.name.endswith(".gz") else f.stat().st_size for f in files)
        assert len(list(made.glob("_data/*"))) == 2 and 0 < size < text / 4


def test_plain_documents_are_still_read(spark):
    """Versions from before documents were compressed, and files that came another way."""
    path = work_folder(spark, "plain")
    docs(spark).select(F.to_json("doc").alias("value")).write.text(path)
    assert documents.read_recipes(spark, path, docs(spark).limit(0)).first() == docs(spark).first()
    assert documents.migrate_stored(spark, path, DISHES, INGREDIENTS)
    assert documents.read_recipes(spark, path, docs(spark)).first()["doc"]["a"]["name"] == "Carrot soup"


def test_documents_are_parsed_once(spark):
    path = work_folder(spark, "once")
    documents.write_recipes(spark.createDataFrame([({},), (None,), ({"a": ("x", 1.0, 2.0, None)},)], f"doc {recipes.DOCUMENT}"), path)
    rows = recipes.recipes_flatten(documents.read_recipes(spark, path, docs(spark)))
    assert planned(rows).count("from_json(") == 1
    assert [tuple(r) for r in rows.collect()] == [("a", "x", 1.0, 2.0, None)]


def test_running_sums_cross_stretches(spark):
    rows = [(k % 3, k, k % 7) for k in range(200)]
    df = spark.createDataFrame(rows, "key int, at bigint, n int")
    found = {(r["key"], r["at"]): r["sum"] for r in pages.running_sum(df, "key", "at", df["n"], "sum", stretch=10).collect()}
    assert found == {(k, at): sum(n for x, a, n in rows if x == k and a <= at) for k, at, _ in rows}


def test_log_takes_arrays_only(spark):
    path = work_folder(spark, "l")
    assert documents.read_log(spark, path, "id bigint").count() == 0
    bodies = spark.createDataFrame([('[{"id": 1}, {"id": 2}]',), ('{"id": 3}',), ("5",), ("[1,",), (None,)], "body string")
    assert documents.write_log(bodies, path).count() == 4
    assert sorted(r["id"] for r in documents.read_log(spark, path, "id bigint").collect()) == [1, 2]


def history(spark, rows):
    return spark.createDataFrame([(date(2024, 1, d), s, n) for d, s, n in rows], documents.HISTORY)


def test_upsert_replaces_whole_days_and_is_idempotent(spark):
    path = work_folder(spark, "h")
    old, new = history(spark, [(1, "s0", 1), (1, "s1", 2), (2, "s0", 3)]), history(spark, [(1, "s0", 9), (3, "s0", 4)])
    documents.replace_history(old, path)
    for _ in range(2):
        documents.upsert_history(new, path)
        found = sorted((r["date"].day, r["store_id"], r["n"]) for r in documents.read_history(spark, path).collect())
        assert found == [(1, "s0", 9), (2, "s0", 3), (3, "s0", 4)]
    assert sorted(map(tuple, documents.upserted(old, new).select("date", "store_id", "n").collect())) == sorted(map(tuple, documents.read_history(spark, path).select("date", "store_id", "n").collect()))


def test_nested_history(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"date": "2024-01-02", "stores": {"s0": 3, "s1": 0}, "total": 3}\n{"date": "2024-01-03", "stores": {}, "total": 0}\n')
    assert sorted(map(tuple, documents.read_nested_history(spark, str(tmp_path)).collect())) == [(date(2024, 1, 2), "s0", 3), (date(2024, 1, 2), "s1", 0)]
    (tmp_path / "i.json").write_text("{nonsense\n")
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        documents.read_nested_history(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        documents.read_nested_history(spark, work_folder(spark, "none")).collect()


def test_missing_history_raises(spark):
    with pytest.raises(FileNotFoundError):
        documents.read_history(spark, work_folder(spark, "none"))


SUPPLIER = '{"supplier": "A", "date": "2024-01-02", "amount": 12.5}'


def test_invoices(spark):
    texts = [
        SUPPLIER,
        '{"supplier": null, "date": null, "amount": null}',
        f"Sure! It\'s {{here}}: {SUPPLIER}\nAnything else?",
        f'```json\n{SUPPLIER}\n``` and {{"supplier": "later"}}',
        '{"note": "a } brace, a \\"quote\\" and a \\\\", "supplier": "A", "date": "2024-01-02", "amount": 12.5, "more": {"x": [1, {"y": 2}]}}',
        f'{{"other": {{"a": 1}}}} {SUPPLIER}',
        "x" * 20_000 + SUPPLIER,
    ]
    bad = ['{"supplier": "B", "da', "none", None, "", "{}", '{"other": 1}', '{"supplier": "A", "amount": "much"}', "[1, 2]", '"{"', f"an open {{ brace {SUPPLIER}"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *bad])], "id bigint, text string")
    found = {r["id"]: r for r in invoices.parse_invoice_replies(rows).collect()}
    assert [found[k]["ok"] for k in range(len(texts))] == [True] * len(texts)
    for k in (0, 2, 3, 4, 5, 6):
        assert (found[k]["supplier"], found[k]["date"], float(found[k]["amount"])) == ("A", date(2024, 1, 2), 12.5), texts[k]
    assert found[1]["supplier"] is None
    rejects = sorted((r["id"], r["text"]) for r in invoices.invoice_rejects(rows).collect())
    assert rejects == [(len(texts) + k, t) for k, t in enumerate(bad)]
    assert all(found[k]["supplier"] is None for k, _ in rejects)


def brute_objects(text):
    out, depth, quoted, escaped, start = [], 0, False, False, 0
    for at, c in enumerate(text):
        if depth and quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == "{":
            start, depth = (start, depth + 1) if depth else (at, 1)
        elif depth and c == '"':
            quoted = True
        elif depth and c == "}":
            depth -= 1
            if not depth:
                out.append(text[start : at + 1])
    return out


def test_balanced_objects_equal_brute_force(spark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice('{}"\\aé🙂') for _ in range(rng.randint(0, 25))) for _ in range(600)]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", invoices.objects(F.col("text")).alias("o")).collect()
    assert [r["o"] for r in found] == [brute_objects(r["text"]) for r in found]


ITEMS = [("s0", datetime(2024, 5, 1, 8), "LEMON tart"), ("s0", datetime(2024, 5, 1, 21), "lemon"), ("s1", datetime(2024, 5, 1, 9), None), ("s0", datetime(2024, 4, 30, 22, 30), "lemon")]


def test_tallies(spark):
    df = spark.createDataFrame(ITEMS, "store_id string, ts timestamp_ntz, productname string")
    stores = spark.createDataFrame([("s0", "A"), ("s1", "B"), ("s2", "C")], "store_id string, name string")
    day = sales.tally_today(df, stores, "Lemon", "2024-05-01").first()
    assert day["stores"] == {"s0": 3, "s1": 0, "s2": 0} and day["total"] == 3
    assert {(r["date"].day, r["store_id"]): r["n"] for r in sales.tally_until_cutoff(df, "lemon").collect()} == {(1, "s0"): 2, (1, "s1"): 0}


def test_stream_equals_batch_and_replay_changes_nothing(spark):
    at = work_folder(spark, "s")
    df = spark.createDataFrame(ITEMS, "store_id string, ts timestamp_ntz, productname string")
    df.write.parquet(f"{at}/in")
    read = lambda: sorted(map(tuple, documents.read_history(spark, f"{at}/history").select("date", "store_id", "n").collect()))
    want = sorted(map(tuple, sales.tally_until_cutoff(df, "lemon").collect()))
    for k in range(2):
        run_daily_tally(spark.readStream.schema(df.schema).parquet(f"{at}/in"), "lemon", f"{at}/history", f"{at}/checkpoint{k}", cutoff=22)
        assert read() == want
    late = spark.createDataFrame([("s1", datetime(2024, 5, 1, 10), "lemon")], df.schema)
    late.write.mode("append").parquet(f"{at}/in")
    run_daily_tally(spark.readStream.schema(df.schema).parquet(f"{at}/in"), "lemon", f"{at}/history", f"{at}/checkpoint1", cutoff=22)
    assert (date(2024, 5, 1), "s1", 1) in read() and (date(2024, 5, 1), "s0", 2) in read()


def closing(spark, at, rows, ticks):
    items = spark.createDataFrame(rows, "id bigint, store_id string, ts timestamp_ntz, productname string")
    items.write.mode("append").parquet(f"{at}/items")
    clock = spark.createDataFrame([(t,) for t in ticks], "ts timestamp_ntz")
    clock.write.mode("append").parquet(f"{at}/ticks")
    run_closing_tally(spark.readStream.schema(items.schema).parquet(f"{at}/items"), spark.readStream.schema(clock.schema).parquet(f"{at}/ticks"), "lemon", f"{at}/history", f"{at}/checkpoint", f"{at}/late")
    return sorted((r["date"].day, r["store_id"], r["n"]) for r in documents.read_history(spark, f"{at}/history").collect())


def test_saved_days_never_change_and_late_items_are_counted(spark):
    at = work_folder(spark, "c")
    first = [(k, *r) for k, r in enumerate(ITEMS)] + [(0, *ITEMS[0])]  # one comes twice
    assert closing(spark, at, first, []) == []  # the day isn't over
    assert closing(spark, at, [(10, "s1", datetime(2024, 5, 1, 20), "lemon")], [datetime(2024, 5, 1, 22)]) == []  # 00:00 in local time, but items may come for two hours more
    saved = closing(spark, at, [(11, None, datetime(2024, 5, 1, 20), "lemon")], [datetime(2024, 5, 2, 0, 30)])
    assert saved == [(1, "s0", 3), (1, "s1", 1)]
    late = [(12, "s0", datetime(2024, 5, 1, 9), "lemon"), (13, "s2", datetime(2024, 5, 1, 9), "lemon"), (14, "s0", datetime(2024, 5, 2, 9), "lemon")]
    assert closing(spark, at, late, [datetime(2024, 5, 3, 2)]) == [*saved, (2, "s0", 1)]
    counted = spark.read.parquet(f"{at}/late").collect()
    assert sum(r["n_late"] for r in counted) == 2
    again = spark.createDataFrame([(date(2024, 5, 1), "s0", 99)], documents.HISTORY)
    documents.save_days(again, f"{at}/history")  # as a replay of the sink would
    assert sorted((r["date"].day, r["store_id"], r["n"]) for r in documents.read_history(spark, f"{at}/history").collect()) == [*saved, (2, "s0", 1)]
