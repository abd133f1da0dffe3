"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.functions import clock, numbers, text
from storeops.operators import invoices, labor, recipes, sales
from storeops.plans import bindings as B
from storeops.sources import documents, landing, pages
from storeops.sources.folders import commit, latest, work_folder
from storeops.streaming.tally import LATE, run_closing_tally, run_daily_tally

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Bounds of the range queries: unix seconds of 2024-01-05 and 2024-01-20 UTC.
LO, HI = 1704412800, 1705708800
DAY = "2024-01-10"


def query(needs: str, select: str) -> Callable[[Query], Query]:
    """Registers a query under its name with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = B.sql(needs, select)
        return f

    return add


# Scans and sources


@query("pages", """SELECT endpoint, event_id, user_id FROM pages_ WHERE endpoint <> 'error' OR "offset" = 0""")
def read_pages(spark, d):
    return pages.read_pages(B.pages(spark, d))


@query("sales", f"SELECT store_id, event_id, amount FROM sales WHERE store_id = 's2' AND epoch(ts) >= {LO} AND epoch(ts) < {HI}")
def sales_range(spark, d):
    return sales.sales_range(B.sales(spark, d), "s2", LO, HI).select("store_id", "event_id", "amount")


@query("sales", f"""SELECT store_id, count(*) AS n_rows, sum(amount)::DECIMAL(18,2) AS amount, NULL::VARCHAR AS problem FROM sales
    WHERE store_id IN ('s0', 's1', 's2', 's3', 's4') AND epoch(ts) >= {LO} AND epoch(ts) < {HI} GROUP BY store_id
    UNION ALL SELECT 's5', NULL, NULL, 'no source'""")
def sales_all_stores(spark, d):
    path = work_folder(spark, "sales")
    landing.lay_out(B.sales(spark, d), path)
    sources = {store: open_ for store, open_ in B.store_sources(spark, path).items() if store != "s5"}
    rows, audit = sales.sales_all_stores(sources, B.store_dim(spark), LO, HI)
    found = rows.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount").cast("decimal(18,2)").alias("amount"))
    return found.unionByName(audit, allowMissingColumns=True)


@query("sales", f"""SELECT store_id, count(*) AS n_rows, sum(amount)::DECIMAL(18,2) AS amount, NULL::VARCHAR AS problem FROM sales
    WHERE store_id IN ('s0', 's1', 's2', 's3', 's5') AND epoch(ts) >= {LO} AND epoch(ts) < {HI} GROUP BY store_id
    UNION ALL SELECT 's4', NULL, NULL, 'unreadable: USER_RAISED_EXCEPTION'""")
def sales_broken_source(spark, d):
    """The source of one store breaks in the middle: the others' sales, and why that one is left out."""
    path = work_folder(spark, "sales")
    landing.lay_out(B.sales(spark, d), path)
    rows, audit = sales.sales_all_stores(B.store_sources(spark, path, broken="s4"), B.store_dim(spark), LO, HI)
    found = rows.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount").cast("decimal(18,2)").alias("amount"))
    return found.unionByName(audit, allowMissingColumns=True)


@query("items stores", """, c AS (SELECT store_id, (SELECT count(*) FROM items i WHERE i.store_id = stores.store_id AND contains(i.productname, 'chas')) AS n FROM stores WHERE store_id <> 's1')
    SELECT store_id, sum(n)::BIGINT AS n, grouping(store_id)::INTEGER AS is_total FROM c GROUP BY ROLLUP (store_id)""")
def tally_broken_source(spark, d):
    """As the tally by store, where the source of one breaks: neither the store nor the total has its items."""
    all_items = B.items(spark, d)

    def source(store: str):
        name = F.when(F.col("productname") == "view", F.raise_error(F.lit("connection lost"))).otherwise(F.col("productname"))
        return lambda: all_items.filter(F.col("store_id") == store).withColumn("productname", name if store == "s1" else F.col("productname")).drop("store_id")

    counts, _ = sales.tally_all_stores({f"s{k}": source(f"s{k}") for k in range(6)}, B.store_dim(spark), B.WORD)
    return counts


@query("sales", f"SELECT store_id, event_id, amount FROM sales WHERE store_id = 's2' AND epoch(ts) >= {LO} AND epoch(ts) < {HI}")
def sales_range_laid_out(spark, d):
    """The range of one store where sales lie in a folder for each store: one is read."""
    path = work_folder(spark, "sales")
    landing.lay_out(B.sales(spark, d), path)
    return sales.sales_range(landing.read_laid_out(spark, path, B.SALES), "s2", LO, HI).select("store_id", "event_id", "amount")


@query("sales", "SELECT store_id, event_id, amount FROM sales WHERE store_id IN ('s1', 's4')")
def sales_of_stores(spark, d):
    """The stores are found by name while the query runs, and only their folders are read."""
    path = work_folder(spark, "sales")
    landing.lay_out(B.sales(spark, d), path)
    stores = B.event_stores(spark, d).filter(F.col("name").isin("Store 1", "Store 4"))
    return sales.sales_of_stores(landing.read_laid_out(spark, path, B.SALES), stores).select("store_id", "event_id", "amount")


def landed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = work_folder(spark, "pages")
    landing.write_landed_pages(B.page_texts(spark, d), path)
    return landing.read_landed_pages(spark, path, "event_id:bigint,user_id:bigint", bundled=True)


@query("pages", """SELECT endpoint, event_id, user_id FROM pages_ WHERE (endpoint <> 'error' OR "offset" = 0) AND "offset" // 100 % 7 <> 1""")
def landed_pages(spark, d):
    """The rows of page files, but for those that break off."""
    return pages.read_pages(landed(spark, d)[0])


@query("pages", """SELECT DISTINCT endpoint, "offset", 'broken' AS problem FROM pages_ WHERE "offset" // 100 % 7 = 1""")
def landed_page_rejects(spark, d):
    return landed(spark, d)[1].select("endpoint", "offset", "problem")


@query("items", f"SELECT store_id, coalesce(productname, '') AS product, floor(epoch(ts))::BIGINT AS ts FROM items WHERE store_id = 's3' AND local_ts::DATE = DATE '{DAY}'")
def item_sales_for_day(spark, d):
    found = sales.item_sales_for_day(B.items(spark, d), "s3", DAY)
    return found.select("store_id", F.coalesce("productname", F.lit("")).alias("product"), clock.unix_seconds(F.col("ts")).alias("ts"))


@query("shifts", "SELECT id, employee_id FROM shifts WHERE start_dt::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def shifts_in_range(spark, d):
    return labor.shifts_in_range(B.shifts(spark, d), "2024-01-05", "2024-01-12").select("id", "employee_id")


def payroll(spark: SparkSession, d: str) -> DataFrame:
    return labor.resolve_payroll_fields(B.payroll_raw(spark, d))


@query("payroll", "SELECT employee_id, cost, department_id, day FROM payroll WHERE day BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' AND department_id <= 105")
def payroll_in_range(spark, d):
    return labor.payroll_in_range(payroll(spark, d), B.dept_dim(spark), "1995-01-01", "1999-12-31").select("employee_id", "cost", "department_id", "day")


@query("shifts", "SELECT id, employee_id, department_id FROM shifts ORDER BY id LIMIT 10 OFFSET 5")
def sample_page(spark, d):
    return pages.sample_page(B.shifts(spark, d).select("id", "employee_id", "department_id"), ["id"], 10, 5)


RECIPES = "SELECT recipe_id, any_value(name) AS name, any_value(portion) AS default_portion, any_value(batch) AS batch_size, count(*) AS n_ingredients FROM recipes GROUP BY recipe_id"


def flat(docs: DataFrame) -> DataFrame:
    rows = recipes.recipes_flatten(docs)
    return rows.select("recipe_id", "name", F.col("defaultPortion").alias("default_portion"), F.col("batchSize").alias("batch_size"), F.size("ingredients").cast("bigint").alias("n_ingredients"))


@query("recipes", RECIPES)
def read_recipes(spark, d):
    """Without a document the default is read."""
    return flat(documents.read_recipes(spark, work_folder(spark, "none"), B.recipes(spark, d)))


@query("recipes", RECIPES)
def write_recipes(spark, d):
    path = work_folder(spark, "recipes")
    docs = B.recipes(spark, d)
    documents.write_recipes(docs, path)
    documents.write_recipes(documents.read_recipes(spark, path, docs.limit(0)), path)  # over what is being read
    return flat(documents.read_recipes(spark, path, docs.limit(0)))


@query("", "SELECT event_id, event_type FROM events WHERE event_id % 4 = 0")
def read_log(spark, d):
    path = work_folder(spark, "log")
    documents.write_log(B.log_bodies(spark, d), path)
    return documents.read_log(spark, path, "event_id bigint, event_type string")


@query("", "SELECT event_id AS id FROM events WHERE event_id % 4 <> 0")
def write_log(spark, d):
    """The bodies that were rejected."""
    return documents.write_log(B.log_bodies(spark, d), work_folder(spark, "log")).select("id")


@query("items daily old", "SELECT date, store_id, n FROM old")
def read_history(spark, d):
    """From the nested form, as it lies in JSON files, to rows."""
    path = work_folder(spark, "nested")
    sales.nested(B.history_old(spark, d)).write.json(path)
    return documents.read_nested_history(spark, path).select("date", "store_id", "n")


@query("items daily old", "SELECT date, store_id, n FROM old")
def replace_history(spark, d):
    path = work_folder(spark, "history")
    documents.replace_history(B.history_new(spark, d), path)
    documents.replace_history(B.history_old(spark, d), path)
    return documents.read_history(spark, path)


@query("items daily old new", "SELECT date, store_id, n FROM new UNION ALL SELECT date, store_id, n FROM old WHERE date NOT IN (SELECT date FROM new)")
def upsert_history(spark, d):
    path = work_folder(spark, "history")
    documents.replace_history(B.history_old(spark, d), path)
    documents.upsert_history(B.history_new(spark, d), path)
    return documents.read_history(spark, path)


@query("items daily old new", """SELECT 'before' AS state, date, store_id, n FROM old UNION ALL SELECT 'after', date, store_id, n FROM new
    UNION ALL SELECT 'after', date, store_id, n FROM old WHERE date NOT IN (SELECT date FROM new)""")
def history_snapshot(spark, d):
    """What a reader has who began before an upsert, and one who begins after it."""
    path = work_folder(spark, "history")
    documents.replace_history(B.history_old(spark, d), path)
    before = documents.read_history(spark, path, latest(spark, path))
    documents.upsert_history(B.history_new(spark, d), path)
    states = {"before": before, "after": documents.read_history(spark, path)}
    return reduce(DataFrame.unionByName, [df.withColumn("state", F.lit(name)) for name, df in states.items()])


@query("items daily old new", "SELECT date, store_id, n FROM new UNION ALL SELECT date, store_id, n FROM old WHERE date NOT IN (SELECT date FROM new)")
def history_two_writers(spark, d):
    """Another writer publishes the old days between this one's first look and its publishing; no day is lost."""
    path = work_folder(spark, "history")
    mine, others = documents.write_days(B.history_new(spark, d), path), documents.write_days(B.history_old(spark, d), path)

    def change(base):
        if base is None:
            commit(spark, path, lambda _: others)
        return (base.parts if base else {}) | mine

    commit(spark, path, change)
    return documents.read_history(spark, path)


@query("", """SELECT 'log' AS source, count(*) AS n_rows, 3::BIGINT AS n_columns, 7::BIGINT AS declared, count(*) FILTER (event_id % 4 IN (2, 3)) || ' broken rows' AS problem FROM events
    UNION ALL SELECT 'events', count(*), 6, count(*), NULL FROM events
    UNION ALL SELECT 'orders', count(*), (SELECT count(*) FROM (DESCRIBE orders)), NULL, 'no total' FROM orders""")
def audit_broken_rows(spark, d):
    """Sources read by one plan, of which one has lines that can't be parsed."""
    path = work_folder(spark, "log")
    B.log_bodies(spark, d).select(F.regexp_replace("body", r"^\\[(?=\\{)|(?<=\\})\\]$", "")).write.text(path)
    sources = {
        "log": lambda: spark.read.schema(f"event_id bigint, event_type string, {pages.BROKEN} string").json(path),
        "events": lambda: B.table(spark, d, "events"),
        "orders": lambda: B.table(spark, d, "orders"),
    }
    return pages.audit_sources(spark, sources, {"log": 7, "events": B.table(spark, d, "events").count()})


@query("shifts payroll", """SELECT 'shifts' AS source, count(*) AS n_rows, 5::BIGINT AS n_columns, NULL::BIGINT AS declared, 'no total' AS problem FROM shifts
    UNION ALL SELECT 'payroll', count(*), 4, 1, CASE WHEN count(*) <> 1 THEN 'rows differ from total' END FROM payroll
    UNION ALL SELECT 'departments', NULL, NULL, 6, 'unreadable: PATH_NOT_FOUND'""")
def audit_sources(spark, d):
    sources = {"shifts": lambda: B.shifts(spark, d), "departments": lambda: spark.read.parquet(work_folder(spark, "none")), "payroll": lambda: payroll(spark, d)}
    return pages.audit_sources(spark, sources, {"payroll": 1, "departments": 6})


@query("pages", "SELECT endpoint, CASE WHEN endpoint = 'error' THEN least(count(*), 100) ELSE count(*) END AS n FROM pages_ GROUP BY endpoint")
def extract_counts(spark, d):
    return pages.extract_counts(pages.read_pages(B.pages(spark, d)))


@query("pages", """SELECT endpoint, "offset", count(*) AS n_rows, (sum(count(*)) OVER (PARTITION BY endpoint ORDER BY "offset"))::BIGINT AS rows_so_far,
    (sum(count(*)) OVER (PARTITION BY endpoint ORDER BY "offset")) >= CASE WHEN endpoint = 'error' THEN 0 ELSE any_value(total) END AS stops FROM pages_ GROUP BY endpoint, "offset" """)
def page_running_total(spark, d):
    return pages.page_running_total(B.pages(spark, d)).select("endpoint", "offset", "n_rows", "rows_so_far", "stops")


@query("", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 1")
def first_row(spark, d):
    return labor.first_row(B.table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id")


# Columns


@query("items", "SELECT DISTINCT store_id, 'Store ' || substr(store_id, 2) AS name FROM items")
def list_stores(spark, d):
    return sales.list_stores(B.event_stores(spark, d))


KEYS = """keys AS (SELECT event_id AS id, (['s0', 'S1', 's5', 'NØRREBRO', 'nær', 'GÅ', 'unknown', NULL])[event_id % 8 + 1] AS raw FROM events),
    found AS (SELECT id, raw, CASE raw WHEN 's0' THEN 's0' WHEN 'S1' THEN 's1' WHEN 's5' THEN 's5' WHEN 'NØRREBRO' THEN 'norrebro' WHEN 'nær' THEN 'naer' WHEN 'GÅ' THEN 'gaa' END AS store_id FROM keys)"""


@query("", f"WITH {KEYS} SELECT id, store_id FROM found")
def resolve_store(spark, d):
    return sales.resolve_store(B.store_keys(spark, d), B.named_stores(spark)).select("id", "store_id")


@query("", f"WITH {KEYS} SELECT id, raw FROM found WHERE store_id IS NULL")
def unknown_store_rejects(spark, d):
    return sales.unknown_store_rejects(B.store_keys(spark, d), B.named_stores(spark))


@query("shifts", "SELECT id, ms, coalesce(ms, 0) AS ms_or_zero FROM shifts")
def shift_hours(spark, d):
    rows = labor.shift_hours(B.shifts(spark, d))
    return rows.withColumn("kept", F.col("ms")).transform(labor.shift_hours, "zero").select("id", F.col("kept").alias("ms"), F.col("ms").alias("ms_or_zero"))


@query("", "SELECT event_id AS id FROM events WHERE event_id % 5 IN (1, 3)")
def instant_rejects(spark, d):
    return labor.instant_rejects(B.raw_instants(spark, d), "start", "end").select("id")


HOURS4 = "round(ms / 3600000.0, 4)::DECIMAL(18,4)"
COST2 = "round(ms * 160 / 3600000.0, 2)::DECIMAL(18,2)"
WHOLE = "floor((ms * 320 + 3600000) / 7200000.0)::BIGINT"
TEXT2 = """CASE WHEN ms % 450000 = 0 THEN printf('%d.%02d', ((ms // 450000) * 125 + 5) // 1000, (((ms // 450000) * 125 + 5) // 10) % 100)
    ELSE format('{:.2f}', ms / 3600000.0) END"""


@query("shifts", f"SELECT id, {COST2} AS cost FROM shifts")
def shift_cost(spark, d):
    return labor.shift_hours(B.shifts(spark, d)).select("id", numbers.cost(F.col("ms")).alias("cost"))


@query("", f"""SELECT event_id AS id, {HOURS4} AS hours, {COST2} AS cost, {WHOLE} AS whole, {TEXT2} AS hours_text, floor(value - 250.5 + 0.5)::BIGINT AS half_up
    FROM (SELECT *, floor(value * 60)::BIGINT * 1000 AS ms FROM events)""")
def rounding(spark, d):
    ms = (F.floor(F.col("value") * 60) * 1000).cast("bigint")
    rows = B.table(spark, d, "events").withColumn("ms", ms)
    return rows.select(
        F.col("event_id").alias("id"),
        numbers.hours(F.col("ms")).alias("hours"),
        numbers.cost(F.col("ms")).alias("cost"),
        numbers.whole_cost(F.col("ms")).alias("whole"),
        numbers.hours_text(F.col("ms")).alias("hours_text"),
        numbers.round_half_up(F.col("value") - 250.5).alias("half_up"),
    )


@query("payroll", "SELECT employee_id, cost, department_id, day FROM payroll")
def payroll_fields(spark, d):
    return payroll(spark, d)


@query("", "SELECT event_id AS id, user_id AS employee_id FROM events WHERE user_id % 3 <> 0")
def drop_null_employee(spark, d):
    rows = B.table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("employee_id"))
    return labor.drop_null_employee(rows)


@query("", "SELECT event_id AS id, event_type <> 'error' AND event_type LIKE '%chas%' AS hit FROM events")
def product_match(spark, d):
    name = F.upper(F.when(F.col("event_type") != "error", F.col("event_type")))
    return B.table(spark, d, "events").select(F.col("event_id").alias("id"), text.product_matches(name, B.WORD).alias("hit"))


@query("payroll", "SELECT 'totalCost' AS field, count(*) AS n FROM payroll WHERE status = 'F' HAVING count(*) > 0")
def cost_fields(spark, d):
    return pages.cost_fields(B.payroll_json(spark, d))


@query("payroll", """SELECT id, concat_ws(',', CASE WHEN second THEN 'EmployeeId' ELSE 'employeeId' END, 'departmentId', 'day',
    CASE status WHEN 'F' THEN 'totalCost' WHEN 'O' THEN 'total' END) AS fields FROM payroll""")
def row_fields(spark, d):
    return B.payroll_json(spark, d).select("id", F.array_join(text.row_fields(F.col("json")), ",").alias("fields"))


@query("", "SELECT event_id AS id, (floor(epoch(ts))::BIGINT // 86400) * 86400 AS day FROM events")
def utc_day_floor(spark, d):
    return B.table(spark, d, "events").select(F.col("event_id").alias("id"), clock.utc_day_floor(clock.unix_seconds(F.col("ts"))).alias("day"))


@query("", f"SELECT event_id AS id, {B.LOCAL}::DATE AS date FROM events")
def local_date(spark, d):
    return B.table(spark, d, "events").select(F.col("event_id").alias("id"), clock.local_date(F.col("ts")).alias("date"))


@query("", """SELECT day, epoch(timezone('Europe/Copenhagen', day::TIMESTAMP))::BIGINT AS midnight,
    epoch(timezone('Europe/Copenhagen', day::TIMESTAMP + INTERVAL 12 HOUR))::BIGINT - 43200 AS by_noon FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)""")
def local_midnight(spark, d):
    days = B.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    at = lambda mode: clock.unix_seconds(clock.local_midnight(F.col("day"), mode=mode))
    return days.select("day", at("true").alias("midnight"), at("noon_offset").alias("by_noon"))


LABEL = "concat(department_id, ' → ', coalesce(store_id, 'UNKNOWN'))"


@query("shifts depts", f"SELECT id, {LABEL} AS department FROM shifts LEFT JOIN depts USING (department_id)")
def dept_label(spark, d):
    rows = labor.shifts_left_store(B.shifts(spark, d), B.dept_dim(spark))
    return rows.select("id", text.dept_label(F.col("department_id"), F.col("store_id")).alias("department"))


@query("shifts", f"SELECT id, employee_id, department_id, CASE WHEN ms IS NOT NULL THEN {TEXT2} END AS hours_text FROM shifts")
def annotate_shifts(spark, d):
    return labor.annotate_shifts(B.shifts(spark, d)).select("id", "employee_id", "department_id", "hours_text")


@query("shifts depts", f"""SELECT id AS shift_id, employee_id, department_id, store_id, epoch(start_dt)::BIGINT AS start_s, {HOURS4} AS hours, 160::BIGINT AS pay_rate, {COST2} AS cost,
    'id,employee_id,department_id,start_dt,end_dt' AS raw_fields FROM shifts LEFT JOIN depts USING (department_id)""")
def shift_report(spark, d):
    rows = labor.shift_report(B.shifts(spark, d), B.dept_dim(spark))
    return rows.select("shift_id", "employee_id", "department_id", "store_id", clock.unix_seconds(F.col("start_dt")).alias("start_s"), "hours", "pay_rate", "cost", F.array_join("raw_fields", ",").alias("raw_fields"))


@query("", """SELECT o_orderkey AS id, o_orderkey % 10 <> 9 AS ok, CASE WHEN o_orderkey % 10 <> 9 THEN s_name END AS supplier,
    CASE WHEN o_orderkey % 10 <> 9 THEN o_orderdate::DATE END AS date, CASE WHEN o_orderkey % 10 <> 9 THEN o_totalprice::DECIMAL(18,2) END AS amount
    FROM orders JOIN supplier ON s_suppkey = o_orderkey % 10""")
def invoice_fields(spark, d):
    return invoices.parse_invoice_replies(B.invoice_replies(spark, d))


@query("", "SELECT o_orderkey AS id FROM orders JOIN supplier ON s_suppkey = o_orderkey % 10 WHERE o_orderkey % 10 = 9")
def invoice_rejects(spark, d):
    return invoices.invoice_rejects(B.invoice_replies(spark, d)).select("id")


# Joins


@query("shifts depts", "SELECT id, store_id FROM shifts LEFT JOIN depts USING (department_id)")
def shifts_left_store(spark, d):
    return labor.shifts_left_store(B.shifts(spark, d), B.dept_dim(spark)).select("id", "store_id")


@query("shifts depts", "SELECT id, store_id FROM shifts JOIN depts USING (department_id)")
def shifts_inner_store(spark, d):
    return labor.shifts_inner_store(B.shifts(spark, d), B.dept_dim(spark)).select("id", "store_id")


@query("shifts", "SELECT count(*) AS n FROM shifts WHERE department_id > 105")
def unmatched_shifts(spark, d):
    return labor.unmatched_shifts(B.shifts(spark, d), B.dept_dim(spark)).agg(F.count(F.lit(1)).alias("n"))


@query("shifts payroll emp_cost", "SELECT id, employee_id, cost FROM shifts LEFT JOIN emp_cost USING (employee_id)")
def shifts_left_payroll(spark, d):
    return labor.shifts_left_payroll(B.shifts(spark, d), payroll(spark, d)).select("id", "employee_id", "cost")


@query("payroll", "SELECT employee_id, cost, department_id FROM payroll WHERE department_id <= 105")
def payroll_semi_dept(spark, d):
    return labor.payroll_semi_dept(payroll(spark, d), B.dept_dim(spark)).select("employee_id", "cost", "department_id")


@query("items stores", f"""SELECT store_id, coalesce(n, 0) AS n FROM stores LEFT JOIN
    (SELECT store_id, count(*) FILTER (contains(productname, 'chas')) AS n FROM items WHERE local_ts::DATE = DATE '{DAY}' AND store_id <> 's2' GROUP BY store_id) USING (store_id)""")
def tally_zero_fill(spark, d):
    some = B.items(spark, d).filter((clock.local_date(F.col("ts")) == F.lit(DAY).cast("date")) & (F.col("store_id") != "s2"))
    return sales.zero_filled(sales.tally(some, B.WORD, F.col("store_id")), B.store_dim(spark))


def renames(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "old string, new string")


DISH = "CASE name WHEN 'small ring' THEN 'ring, small' WHEN 'red widget' THEN 'widget' ELSE name END"
INGREDIENT = "CASE ingredient WHEN 'AF' THEN 'alpha' WHEN 'NO' THEN 'nu' WHEN 'RF' THEN 'alpha' ELSE ingredient END"


@query("recipes", f"SELECT DISTINCT recipe_id, {DISH} AS name FROM recipes")
def rename_dishes(spark, d):
    return recipes.renamed(recipes.recipes_flatten(B.recipes(spark, d)), renames(spark, B.DISHES)).select("recipe_id", "name")


@query("recipes", f"SELECT recipe_id, place, {INGREDIENT} AS name FROM recipes")
def rename_ingredients(spark, d):
    rows = recipes.renamed(recipes.recipe_ingredients(B.recipes(spark, d)), renames(spark, B.INGREDIENTS))
    return rows.select("recipe_id", F.col("place").cast("bigint").alias("place"), "name")


# Aggregates and windows


@query("payroll emp_cost", "SELECT employee_id, cost FROM emp_cost")
def cost_per_employee(spark, d):
    return labor.cost_per_employee(payroll(spark, d))


@query("shifts", """, n AS (SELECT employee_id, ceil(count(*) / 50)::BIGINT AS parts FROM shifts GROUP BY employee_id)
    SELECT employee_id, id % parts AS part, string_agg(department_id || ':' || coalesce(ms, 0), ',' ORDER BY id) AS shifts FROM shifts JOIN n USING (employee_id) GROUP BY ALL""")
def shifts_per_employee(spark, d):
    rows = labor.shifts_per_employee(B.shifts(spark, d), longest=50)
    told = F.transform("shifts", lambda s: F.concat_ws(":", s["department_id"], s["ms"]))
    return rows.select("employee_id", "part", F.array_join(told, ",").alias("shifts"))


@query("shifts depts", f"""SELECT {LABEL} AS department, count(*) AS shift_count, coalesce(sum({HOURS4}), 0)::DECIMAL(18,4) AS total_hours,
    coalesce(sum({COST2}), 0)::DECIMAL(18,2) AS total_cost FROM shifts LEFT JOIN depts USING (department_id) GROUP BY 1""")
def labor_by_department(spark, d):
    return labor.labor_by_department(B.shifts(spark, d), B.dept_dim(spark))


@query("shifts", "SELECT count(*) AS total_shifts, 160::BIGINT AS hourly_rate FROM shifts")
def labor_summary(spark, d):
    return labor.labor_summary(B.shifts(spark, d))


SHARE = "CASE WHEN emp_ms > 0 THEN coalesce(ms, 0) / emp_ms ELSE 1.0 / emp_shifts END"
HYBRID = f"""SELECT store_id, floor(sum(coalesce(cost::DOUBLE, emp_ms * 160 / 3600000.0) * {SHARE}) + 0.5)::BIGINT AS labor_cost
    FROM shifts JOIN emp USING (employee_id) LEFT JOIN emp_cost USING (employee_id) JOIN depts USING (department_id) GROUP BY store_id"""


@query("shifts payroll emp_cost emp depts", HYBRID)
def labor_by_store_hybrid(spark, d):
    return labor.labor_by_store_hybrid(B.shifts(spark, d), payroll(spark, d), B.dept_dim(spark))


HOURLY = f"SELECT store_id, sum({WHOLE.replace('ms', 'coalesce(ms, 0)')})::BIGINT AS labor_cost FROM shifts JOIN depts USING (department_id) GROUP BY store_id"


@query("shifts depts", HOURLY)
def labor_by_store_hourly(spark, d):
    return labor.labor_by_store_hourly(B.shifts(spark, d), B.dept_dim(spark))


@query("shifts depts", HOURLY)
def labor_by_store(spark, d):
    """The payroll didn't land."""
    path = work_folder(spark, "labor")
    return labor.labor_by_store(B.shifts(spark, d), lambda: spark.read.parquet(f"{path}/payroll"), B.dept_dim(spark))


@query("shifts payroll emp_cost emp depts", HYBRID)
def labor_by_store_landed(spark, d):
    """The payroll landed and is read."""
    path = work_folder(spark, "labor")
    payroll(spark, d).write.parquet(f"{path}/payroll")
    return labor.labor_by_store(B.shifts(spark, d), lambda: spark.read.parquet(f"{path}/payroll"), B.dept_dim(spark))


@query("shifts payroll emp_cost emp depts", f""", cost AS ({HYBRID}) SELECT store_id AS name, labor_cost AS value FROM cost
    UNION ALL SELECT 'shifts', count(*) FROM shifts UNION ALL SELECT 'no_employee', count(*) FROM shifts WHERE employee_id IS NULL
    UNION ALL SELECT 'no_times', count(*) FROM shifts WHERE ms IS NULL UNION ALL SELECT 'unmatched', count(*) FROM shifts WHERE department_id > 105
    UNION ALL SELECT CASE WHEN cost IS NULL THEN 'hourly' ELSE 'salaried' END, count(DISTINCT employee_id) FROM shifts LEFT JOIN emp_cost USING (employee_id) GROUP BY 1""")
def labor_by_store_counted(spark, d):
    """The report and what it leaves out, of one run."""
    rows, counters = labor.labor_by_store_counted(B.shifts(spark, d), payroll(spark, d), B.dept_dim(spark))
    return rows.toDF("name", "value").unionByName(spark.createDataFrame(list(counters.items()), "name string, value bigint"))


@query("shifts payroll emp_cost", """SELECT count(DISTINCT employee_id) FILTER (cost IS NOT NULL) AS salaried, count(DISTINCT employee_id) FILTER (cost IS NULL) AS hourly,
    count(*) FILTER (department_id > 105) AS unmatched, (SELECT count(DISTINCT employee_id) FROM payroll) AS with_payroll FROM shifts LEFT JOIN emp_cost USING (employee_id)""")
def labor_counters(spark, d):
    return labor.labor_counters(B.shifts(spark, d), payroll(spark, d), B.dept_dim(spark))


@query("payroll", "SELECT DISTINCT employee_id FROM payroll")
def payroll_employees(spark, d):
    return labor.payroll_employees(payroll(spark, d))


@query("items stores", """, c AS (SELECT store_id, (SELECT count(*) FROM items i WHERE i.store_id = stores.store_id AND contains(i.productname, 'chas')) AS n FROM stores)
    SELECT store_id, sum(n)::BIGINT AS n, grouping(store_id)::INTEGER AS is_total FROM c GROUP BY ROLLUP (store_id)""")
def tally_by_store(spark, d):
    return sales.tally_by_store(B.items(spark, d), B.store_dim(spark), B.WORD)


@query("shifts emp", "SELECT id, emp_ms FROM shifts JOIN emp USING (employee_id)")
def emp_total_hours(spark, d):
    return labor.with_employee_totals(B.shifts(spark, d)).select("id", "emp_ms")


@query("shifts emp", "SELECT id, emp_shifts FROM shifts JOIN emp USING (employee_id)")
def emp_shift_count(spark, d):
    return labor.with_employee_totals(B.shifts(spark, d)).select("id", "emp_shifts")


@query("shifts emp", f"SELECT id, round({SHARE}, 9)::DECIMAL(18,9) AS share FROM shifts JOIN emp USING (employee_id)")
def alloc_share(spark, d):
    rows = labor.with_employee_totals(B.shifts(spark, d))
    return rows.select("id", F.round(labor.alloc_share(), 9).cast("decimal(18,9)").alias("share"))


# Nested documents


@query("recipes", RECIPES)
def recipes_flatten(spark, d):
    return flat(B.recipes(spark, d))


@query("recipes", "SELECT recipe_id, place, ingredient AS name, grams FROM recipes")
def recipe_ingredients(spark, d):
    return recipes.recipe_ingredients(B.recipes(spark, d)).withColumn("place", F.col("place").cast("bigint"))


@query("recipes", f"SELECT recipe_id, any_value({DISH}) AS name, string_agg({INGREDIENT}, ',' ORDER BY place) AS ingredients FROM recipes GROUP BY recipe_id")
def migrate_recipes(spark, d):
    """The stored documents after the job."""
    path = work_folder(spark, "recipes")
    documents.write_recipes(B.recipes(spark, d), path)
    documents.migrate_stored(spark, path, B.DISHES, B.INGREDIENTS)
    done = recipes.recipes_flatten(documents.read_recipes(spark, path, spark.createDataFrame([], f"doc {recipes.DOCUMENT}")))
    return done.select("recipe_id", "name", F.array_join("ingredients.name", ",").alias("ingredients"))


@query("recipes", f"SELECT bool_or({DISH} <> name OR {INGREDIENT} <> ingredient) AS changed FROM recipes")
def recipes_changed(spark, d):
    """Whether the migration has anything to write."""
    return recipes.recipes_changed(B.recipes(spark, d), B.DISHES, B.INGREDIENTS)


@query("recipes", f"SELECT bool_or({DISH} <> name OR {INGREDIENT} <> ingredient) AS first_wrote, false AS second_wrote FROM recipes")
def migrate_recipes_twice(spark, d):
    """Whether the job wrote, and whether it did once more on its own result."""
    path = work_folder(spark, "recipes")
    documents.write_recipes(B.recipes(spark, d), path)
    wrote = [documents.migrate_stored(spark, path, B.DISHES, B.INGREDIENTS) for _ in range(2)]
    return spark.createDataFrame([tuple(wrote)], "first_wrote boolean, second_wrote boolean")


def told(nested: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("stores"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return nested.select("date", F.array_join(entries, ",").alias("stores"), "total")


NESTED = "SELECT date, string_agg(store_id || ':' || n, ',' ORDER BY store_id) AS stores, sum(n)::BIGINT AS total FROM"


@query("items daily", f"{NESTED} daily GROUP BY date")
def tally_nested(spark, d):
    return told(sales.nested(B.daily_counts(spark, d)))


@query("items stores", f"""{NESTED} (SELECT DATE '{DAY}' AS date, store_id, (SELECT count(*) FROM items i WHERE i.store_id = stores.store_id
    AND contains(i.productname, 'chas') AND local_ts::DATE = DATE '{DAY}') AS n FROM stores) GROUP BY date""")
def tally_today(spark, d):
    return told(sales.tally_today(B.items(spark, d), B.store_dim(spark), B.WORD, DAY))


CUTOFF = "SELECT local_ts::DATE AS date, store_id, count(*) FILTER (contains(coalesce(productname, ''), 'chas')) AS n FROM items WHERE hour(local_ts) < 22 GROUP BY ALL"


@query("items", CUTOFF)
def tally_until_cutoff(spark, d):
    return sales.tally_until_cutoff(B.items(spark, d), B.WORD)


# Streams


def stream(spark: SparkSession, d: str) -> DataFrame:
    return B.items_of(spark.readStream.schema(B.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*"))  # a pattern may stand for one file, a plain path must be a folder


@query("items daily", "SELECT date, store_id, n FROM daily")
def stream_daily_tally(spark, d):
    path = work_folder(spark, "stream")
    run_daily_tally(stream(spark, d), B.WORD, f"{path}/history", f"{path}/checkpoint")
    return documents.read_history(spark, f"{path}/history")


@query("items daily old", f"""SELECT * FROM ({CUTOFF}) UNION ALL
    SELECT date, store_id, n FROM old WHERE (date, store_id) NOT IN (SELECT (date, store_id) FROM ({CUTOFF}))""")
def stream_upsert_history(spark, d):
    path = work_folder(spark, "stream")
    documents.replace_history(B.history_old(spark, d), f"{path}/history")
    run_daily_tally(stream(spark, d), B.WORD, f"{path}/history", f"{path}/checkpoint", cutoff=22)
    return documents.read_history(spark, f"{path}/history")


#: Items that come only after all days were saved, and the clock that ends the last day.
LATE_ITEMS, TICK = "event_id % 97 = 0", "2024-02-15 00:00:00"


def closed(spark: SparkSession, d: str) -> str:
    """A folder with the history of days that were saved once, and the audit of what came too late."""
    path = work_folder(spark, "closing")
    events, ticks = B.table(spark, d, "events"), spark.range(1).select(F.lit(TICK).cast("timestamp_ntz").alias("ts"))
    ticks.write.parquet(f"{path}/ticks")
    for late in (False, True):
        events.filter(F.expr(LATE_ITEMS) if late else ~F.expr(LATE_ITEMS)).write.mode("append").parquet(f"{path}/events")
        read = spark.readStream.schema(events.schema).parquet(f"{path}/events")
        items = B.items_of(read, F.col("event_id").alias("id"))
        run_closing_tally(items, spark.readStream.schema(ticks.schema).parquet(f"{path}/ticks"), B.WORD, f"{path}/history", f"{path}/checkpoint", f"{path}/late")
    return path


@query("", f"""SELECT {B.LOCAL}::DATE AS date, 's' || user_id % 7 AS store_id, count(*) FILTER (event_type LIKE '%chas%') AS n FROM events WHERE NOT {LATE_ITEMS} GROUP BY ALL""")
def stream_closing_tally(spark, d):
    """Days are saved when they are over; what comes after changes none of them."""
    return documents.read_history(spark, f"{closed(spark, d)}/history")


@query("", f"SELECT count(*) AS n_late FROM events WHERE {LATE_ITEMS}")
def stream_late_items(spark, d):
    """How many items came too late to be counted."""
    return spark.read.schema(LATE).parquet(f"{closed(spark, d)}/late").agg(F.sum("n_late").alias("n_late"))
