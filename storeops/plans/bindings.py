"""The inputs of the registered queries, derived from the given tables; SQL holds the same as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storeops.functions.clock import local_date
from storeops.operators.sales import tally
from storeops.sources.landing import read_laid_out
from storeops.sources.pages import running_sum

WORD = "chas"
PAGE = 100
#: Order keys whose lines make a recipe, and parts whose recipes come together.
ORDERS, PARTS = 100_000, 20
#: Lines of recipes that a task holds, about, and a document.
LINES, DOC = 500_000, 1_000
DISHES = {"small ring": "ring, small", "red widget": "widget"}
INGREDIENTS = {"AF": "alpha", "NO": "nu", "RF": "alpha"}
RAW_STORES = ["s0", "S1", "s5", "NØRREBRO", "nær", "GÅ", "unknown", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"s{k}", f"Store {k}") for k in range(6)], "store_id string, name string")


def event_stores(spark: SparkSession, d: str) -> DataFrame:
    """The stores that have events."""
    ids = items(spark, d).select("store_id").distinct()
    return ids.withColumn("name", F.concat(F.lit("Store "), F.expr("substring(store_id, 2)"))).withColumn("credential", F.lit("hidden"))


def named_stores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s0",), ("s1",), ("s5",), ("norrebro",), ("naer",), ("gaa",)], "store_id string")


def dept_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(100 + k, f"s{k}") for k in range(6)], "department_id bigint, store_id string")


def shifts(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_trunc("second", "ts").cast("timestamp_ntz")
    end = F.timestamp_add("SECOND", F.floor(F.col("value") * 60).cast("int"), start)
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("employee_id"),
        (100 + F.col("event_id") % 8).alias("department_id"),
        start.alias("start_dt"),
        F.when((F.col("event_type") != "error") & (F.col("user_id") % 10 != 0), end).alias("end_dt"),
    )


def payroll_json(spark: SparkSession, d: str) -> DataFrame:
    """Raw payroll rows as JSON: the id under one of two names, the cost under one of two or none."""
    second = F.col("o_orderpriority").startswith("1")
    cost = F.col("o_totalprice").cast("decimal(18,2)")
    fields = F.struct(
        F.when(~second, F.col("o_custkey")).alias("employeeId"),
        F.when(second, F.col("o_custkey")).alias("EmployeeId"),
        (100 + F.col("o_orderkey") % 8).alias("departmentId"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.when(F.col("o_orderstatus") == "F", cost).alias("totalCost"),
        F.when(F.col("o_orderstatus") == "O", cost).alias("total"),
    )
    return table(spark, d, "orders").filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.to_json(fields).alias("json"))


def payroll_raw(spark: SparkSession, d: str) -> DataFrame:
    raw = payroll_json(spark, d).select("id", F.from_json("json", "map<string,string>").alias("fields"))
    return raw.select("id", "fields", F.col("fields")["departmentId"].cast("bigint").alias("department_id"), F.col("fields")["day"].cast("date").alias("day"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return items_of(table(spark, d, "events"))


def items_of(events: DataFrame, *more: Column) -> DataFrame:
    name = F.when(F.col("event_type") != "error", F.col("event_type"))
    return events.select(*more, F.concat(F.lit("s"), F.col("user_id") % 7).alias("store_id"), "ts", name.alias("productname"))


def sales(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id") % 7).alias("store_id"), "ts", F.col("value").cast("decimal(18,2)").alias("amount"), "event_id")


def store_keys(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(*(F.lit(x).cast("string") for x in RAW_STORES)), (F.col("event_id") % len(RAW_STORES)).cast("int"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), raw.alias("raw"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Landed pages of PAGE rows by event type; that of errors has no total."""
    events = table(spark, d, "events").select("event_type", "event_id", "user_id")
    rows = running_sum(events, "event_type", "event_id", F.lit(1), "rn").withColumn("rn", F.col("rn") - 1)
    held = rows.groupBy(F.col("event_type").alias("endpoint"), (F.floor(F.col("rn") / PAGE) * PAGE).cast("bigint").alias("offset"))
    held = held.agg(F.array_sort(F.collect_list(F.struct("event_id", "user_id"))).alias("data"))
    totals = events.groupBy(F.col("event_type").alias("endpoint")).agg(F.count(F.lit(1)).alias("total"))
    total = F.when(F.col("endpoint") != "error", F.col("total"))
    return held.join(totals, "endpoint").select("endpoint", "offset", "data", F.struct(total.alias("total")).alias("paging"))


def recipes(spark: SparkSession, d: str, held: int = LINES) -> DataFrame:
    """A recipe for each part and stretch of orders, a document for about ``DOC`` lines of a few parts; neither grows with the tables.

    Lines and the heads of recipes are exchanged once, by a few parts, to tasks
    of about ``held`` lines: lists are only collected behind that exchange,
    where they fit into memory whatever the size of the tables. A head goes
    once, however many stretches its part has lines in. A few parts with more
    lines than an eighth of that go in several shares, by stretch, each with
    their heads.
    """
    parts, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    few, stretch = F.floor(F.col("part") / PARTS), F.floor(F.col("l_orderkey") / ORDERS).alias("stretch")
    rows = lines.select(F.col("l_partkey").alias("part"), stretch, F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").alias("grams"))
    many = rows.groupBy(few.alias("few")).agg(F.ceil(F.count(F.lit(1)) / held * 8).alias("shares")).filter("shares > 1")
    many = F.broadcast(many)  # eight for each ``held`` lines at most
    share = F.coalesce(F.pmod("stretch", F.col("shares")), F.lit(0)).alias("share")
    rows = rows.join(many, few == many["few"], "left").select("part", "stretch", share, "name", "grams")
    head = F.struct(F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("defaultPortion"), F.col("p_retailprice").alias("batchSize"))
    heads = parts.select(F.col("p_partkey").alias("part"), head.alias("head")).join(many, few == many["few"], "left")
    heads = heads.select("part", "head", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    tasks = -(-lines.count() // held) or 1
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition(tasks, few, "share").withColumn("few", few)
    # A line without its part has no head, a part without lines no ingredients.
    item = F.when(F.col("head").isNull(), F.struct("name", "grams"))
    lists = dealt.groupBy("few", "share", "part", "stretch").agg(F.array_sort(F.collect_list(item)).alias("ingredients"), F.collect_list("head").alias("heads"))
    of_part, of_share = Window.partitionBy("few", "share", "part"), Window.partitionBy("few", "share")
    docs = F.ceil(F.sum(F.size("ingredients")).over(of_share) / DOC)
    each = lists.withColumn("heads", F.flatten(F.collect_list("heads").over(of_part))).withColumn("of", F.coalesce(F.pmod("stretch", docs), F.lit(0)))
    each = each.filter(F.size("ingredients") > 0).withColumn("head", F.explode("heads"))
    entry = F.struct(F.concat_ws("-", "part", "stretch").alias("key"), F.struct("head.*", "ingredients").alias("value"))
    return each.groupBy("few", "share", "of").agg(F.map_from_entries(F.collect_list(entry)).alias("doc")).select("doc")


def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return tally(items(spark, d), WORD, local_date(F.col("ts")).alias("date"), F.col("store_id"))


def history_old(spark: SparkSession, d: str) -> DataFrame:
    return daily_counts(spark, d).filter("date < date'2024-01-16'").withColumn("n", F.col("n") + 1000)


def history_new(spark: SparkSession, d: str) -> DataFrame:
    return daily_counts(spark, d).filter("date >= date'2024-01-10'")


def log_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Arrays, objects, numbers and malformed texts in turn."""
    k = F.col("event_id") % 4
    array = F.to_json(F.array(F.struct("event_id", "event_type")))
    body = F.when(k == 0, array).when(k == 1, '{"a": 1}').when(k == 2, "5").otherwise("[1,")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), body.alias("body"))


def raw_instants(spark: SparkSession, d: str) -> DataFrame:
    """Date-time texts as they land: some with a zone, some without, broken or missing."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    start = F.when(k == 0, F.concat(text, F.lit("Z"))).when(k == 1, "2024-13-45T00:00:00").when(k != 2, text)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), start.alias("start"), F.when(k == 3, "soon").otherwise(text).alias("end"))


def invoice_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies about orders, alone, in prose, fenced, after another object, or with braces and quotes in a field; every tenth breaks off."""
    suppliers = table(spark, d, "supplier")
    orders = table(spark, d, "orders").withColumn("s_suppkey", F.col("o_orderkey") % 10)
    fields = F.struct(F.col("s_name").alias("supplier"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    json = F.to_json(fields)
    around = [
        json,
        F.concat(F.lit("Here it is: "), json, F.lit(" - and \"that\" is {all}.")),
        F.concat(F.lit("```json\n"), json, F.lit("\n```")),
        F.concat(F.lit('Not {this} or {"other": {"a": 1}}, it\'s "'), json, F.lit('"')),
        F.concat(F.lit('{"note": "a \\"quoted\\" } and { brace", '), F.substring(json, 2, 10_000)),
    ]
    kind = F.floor(F.col("o_orderkey") / 10) % len(around)
    text = F.get(F.array(*around), kind.cast("int"))
    cut = F.when(F.col("o_orderkey") % 10 == 9, F.substring(json, 1, 20)).otherwise(text)
    return orders.join(suppliers, "s_suppkey").select(F.col("o_orderkey").alias("id"), cut.alias("text"))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """The landed pages as the texts of their files; every seventh of an endpoint breaks off."""
    text = F.to_json(F.struct("data", "paging"))
    broken = (F.col("offset") / PAGE) % 7 == 1
    return pages(spark, d).select("endpoint", "offset", F.when(broken, F.substring(text, 1, 40)).otherwise(text).alias("text"))


SALES = "ts timestamp_ntz, amount decimal(18,2), event_id bigint, store_id string"


def store_sources(spark: SparkSession, path: str, broken: str | None = None) -> dict:
    """The six stores' sales in ``path``, laid out by store; the source of one may break in the middle."""
    def source(store: str):
        def open_() -> DataFrame:
            rows = read_laid_out(spark, path, SALES).filter(F.col("store_id") == store).drop("store_id")
            lost = F.when(F.col("event_id") % 10 == 7, F.raise_error(F.lit("connection lost"))).otherwise(F.col("amount"))
            return rows.withColumn("amount", lost) if store == broken else rows

        return open_

    return {f"s{k}": source(f"s{k}") for k in range(6)}


LOCAL = "timezone('Europe/Copenhagen', timezone('UTC', ts))"
CTE = {
    "stores": "stores AS (SELECT 's' || k AS store_id, 'Store ' || k AS name FROM range(6) t(k))",
    "depts": "depts AS (SELECT 100 + k AS department_id, 's' || k AS store_id FROM range(6) t(k))",
    "shifts": """shifts AS (SELECT event_id AS id, user_id AS employee_id, 100 + event_id % 8 AS department_id, date_trunc('second', ts) AS start_dt,
        CASE WHEN event_type <> 'error' AND user_id % 10 <> 0 THEN floor(value * 60)::BIGINT * 1000 END AS ms FROM events)""",
    "payroll": """payroll AS (SELECT o_orderkey AS id, o_custkey AS employee_id, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice::DECIMAL(18,2) ELSE 0 END AS cost,
        100 + o_orderkey % 8 AS department_id, o_orderdate::DATE AS day, left(o_orderpriority, 1) = '1' AS second, o_orderstatus AS status FROM orders WHERE o_custkey % 2 = 0)""",
    "emp_cost": "emp_cost AS (SELECT employee_id, sum(cost)::DECIMAL(18,2) AS cost FROM payroll GROUP BY employee_id)",
    "emp": "emp AS (SELECT employee_id, sum(coalesce(ms, 0))::BIGINT AS emp_ms, count(*) AS emp_shifts FROM shifts GROUP BY employee_id)",
    "items": f"items AS (SELECT 's' || user_id % 7 AS store_id, ts, {LOCAL} AS local_ts, CASE WHEN event_type <> 'error' THEN event_type END AS productname FROM events)",
    "sales": "sales AS (SELECT 's' || user_id % 7 AS store_id, ts, value::DECIMAL(18,2) AS amount, event_id FROM events)",
    "daily": "daily AS (SELECT local_ts::DATE AS date, store_id, count(*) FILTER (contains(coalesce(productname, ''), 'chas')) AS n FROM items GROUP BY ALL)",
    "old": "old AS (SELECT date, store_id, n + 1000 AS n FROM daily WHERE date < DATE '2024-01-16')",
    "new": "new AS (SELECT * FROM daily WHERE date >= DATE '2024-01-10')",
    "pages": """pages_ AS (SELECT event_type AS endpoint, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 * 100 AS "offset", event_id, user_id,
        count(*) OVER (PARTITION BY event_type) AS total FROM events)""",
    "recipes": f"""recipes AS (SELECT p_partkey || '-' || l_orderkey // {ORDERS} AS recipe_id, p_name AS name, p_size::DOUBLE AS portion, p_retailprice AS batch, l_returnflag || l_linestatus AS ingredient, l_quantity AS grams,
        row_number() OVER (PARTITION BY p_partkey, l_orderkey // {ORDERS} ORDER BY l_returnflag || l_linestatus, l_quantity) - 1 AS place FROM part JOIN lineitem ON p_partkey = l_partkey)""",
}


def sql(needs: str, select: str) -> str:
    """A query over the expressions named in ``needs``, which come in the order of their dependence."""
    return (f"WITH {', '.join(CTE[n] for n in needs.split())} " if needs else "") + select
