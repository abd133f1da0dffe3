"""Hand-made cases of the labor rules."""

import warnings
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from storeops.functions import clock, numbers, text
from storeops.operators import labor
from storeops.sources.folders import work_folder

T0 = datetime(2024, 3, 1, 8)


@pytest.fixture(scope="module")
def depts(spark):
    return spark.createDataFrame([(100, "s0"), (101, "s1")], "department_id bigint, store_id string")


def at(seconds):
    return None if seconds is None else datetime.fromtimestamp(T0.timestamp() + seconds)


def shifts(spark, rows):
    data = [(k, e, d, at(a), at(b)) for k, (e, d, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "id bigint, employee_id bigint, department_id bigint, start_dt timestamp_ntz, end_dt timestamp_ntz")


def payroll(spark, rows):
    return spark.createDataFrame([(e, Decimal(c)) for e, c in rows], "employee_id bigint, cost decimal(18,2)")


def stores(df):
    return {r["store_id"]: r["labor_cost"] for r in df.collect()}


def test_missing_end_is_null_in_report_and_zero_in_allocation(spark, depts):
    df = shifts(spark, [(1, 100, 0, None), (1, 100, None, 5), (1, 101, 0, 3600)])
    report = {r["shift_id"]: r for r in labor.shift_report(df, depts).collect()}
    assert report[0]["hours"] is None and report[0]["cost"] is None and report[1]["hours"] is None
    assert report[2]["hours"] == 1 and report[2]["cost"] == 160 and report[2]["pay_rate"] == 160
    assert [r["ms"] for r in labor.shift_hours(df, "zero").orderBy("id").collect()] == [0, 0, 3_600_000]


def test_negative_shift_is_not_clamped(spark, depts):
    df = shifts(spark, [(1, 100, 3600, 0)])
    assert labor.shift_report(df, depts).first()["cost"] == -160
    assert stores(labor.labor_by_store_hourly(df, depts)) == {"s0": -160}


def test_null_employee_counts_in_hourly_only(spark, depts):
    df = shifts(spark, [(None, 100, 0, 3600), (1, 101, 0, 3600)])
    assert stores(labor.labor_by_store_hourly(df, depts)) == {"s0": 160, "s1": 160}
    assert stores(labor.labor_by_store_hybrid(df, payroll(spark, []), depts)) == {"s1": 160}


def test_salary_is_allocated_by_hours_and_unmapped_share_is_dropped(spark, depts):
    df = shifts(spark, [(1, 100, 0, 3600), (1, 101, 0, 7200), (1, 999, 0, 3600)])
    assert stores(labor.labor_by_store_hybrid(df, payroll(spark, [(1, "400")]), depts)) == {"s0": 100, "s1": 200}


@pytest.mark.parametrize("times", [[(0, 0), (0, None)], [(0, 0), (3600, 0)]])
def test_equal_split_without_hours(spark, depts, times):
    df = shifts(spark, [(1, 100, *times[0]), (1, 101, *times[1])])
    assert stores(labor.labor_by_store_hybrid(df, payroll(spark, [(1, "100")]), depts)) == {"s0": 50, "s1": 50}


def test_payroll_of_zero_is_salaried_and_payroll_only_employees_vanish(spark, depts):
    df = shifts(spark, [(1, 100, 0, 3600)])
    assert stores(labor.labor_by_store_hybrid(df, payroll(spark, [(1, "0"), (7, "999")]), depts)) == {"s0": 0}
    counters = labor.labor_counters(df, payroll(spark, [(1, "0"), (7, "999")]), depts).first()
    assert (counters["salaried"], counters["hourly"], counters["unmatched"], counters["with_payroll"]) == (1, 0, 0, 2)


def test_allocated_cost_sums_to_the_employees_cost(spark, depts):
    df = shifts(spark, [(e, 100 + e % 2, 0, 600 * e + 60) for e in range(1, 20) for _ in range(3)])
    shares = labor.with_employee_totals(df).withColumn("share", labor.alloc_share())
    assert all(abs(r["s"] - 1) < 1e-9 for r in shares.groupBy("employee_id").agg(F.sum("share").alias("s")).collect())


def test_employee_totals_equal_a_window(spark):
    df = shifts(spark, [(e, 100, 0, 60 * e) for e in (1, 1, 2, 3, 3, 3)])
    w = Window.partitionBy("employee_id")
    want = labor.shift_hours(df, "zero").select("id", F.sum("ms").over(w).alias("emp_ms"), F.count(F.lit(1)).over(w).alias("emp_shifts"))
    found = labor.with_employee_totals(df).select("id", "emp_ms", "emp_shifts")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_lists_of_shifts_are_bounded(spark):
    df = shifts(spark, [(1, 100 + k, 0, k) for k in range(25)] + [(2, 100, 0, None), (None, 100, 0, 1)])
    found = labor.shifts_per_employee(df, longest=10).collect()
    assert sorted((r["employee_id"], r["part"], len(r["shifts"])) for r in found) == [(1, 0, 9), (1, 1, 8), (1, 2, 8), (2, 0, 1)]
    assert sorted((s["id"], s["department_id"], s["ms"]) for r in found if r["employee_id"] == 1 for s in r["shifts"]) == [(k, 100 + k, 1000 * k) for k in range(25)]
    assert all([s["id"] for s in r["shifts"]] == sorted(s["id"] for s in r["shifts"]) for r in found)


def test_unreadable_payroll_falls_back_but_empty_does_not(spark, depts, tmp_path):
    df = shifts(spark, [(1, 100, 0, 10), (1, 100, 0, 10)])
    folder = work_folder(spark, "t")  # the same for each run
    by_store = lambda source: stores(labor.labor_by_store(df, source, depts, folder))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 nonsense")
    missing = lambda: spark.read.parquet(f"{tmp_path}/none")
    broken = lambda: spark.read.schema("employee_id bigint, cost decimal(18,2)").parquet(str(tmp_path))
    for source in (missing, broken):
        with pytest.warns(UserWarning, match="falls back"):
            assert by_store(source) == {"s0": 0}
    assert by_store(lambda: payroll(spark, [])) == {"s0": 1}
    paid = lambda: payroll(spark, [(1, "999")])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert [by_store(paid) for _ in range(2)] == [{"s0": 999}] * 2


def test_a_folder_that_cant_be_written_is_no_unreadable_payroll(spark, depts, tmp_path):
    (tmp_path / "file").write_text("no folder")
    df = shifts(spark, [(1, 100, 0, 3600)])
    with warnings.catch_warnings(), pytest.raises(Exception, match="(?i)mkdirs|not a directory|create"):
        warnings.simplefilter("error")
        labor.labor_by_store(df, lambda: payroll(spark, [(1, "999")]), depts, f"{tmp_path}/file/costs")


def test_counters_of_the_same_run(spark, depts):
    df = shifts(spark, [(1, 100, 0, 3600), (1, 999, 0, 3600), (2, 101, 0, None), (None, 100, 0, 60), (3, 101, 0, 3600)])
    rows, counters = labor.labor_by_store_counted(df, payroll(spark, [(1, "100"), (9, "5")]), depts)
    assert counters == {"shifts": 5, "no_employee": 1, "no_times": 1, "unmatched": 1, "salaried": 1, "hourly": 2}
    assert stores(rows) == stores(labor.labor_by_store_hybrid(df, payroll(spark, [(1, "100"), (9, "5")]), depts)) == {"s0": 50, "s1": 160}


def test_unparsable_instants_are_told_apart_from_missing_ones(spark):
    rows = [(1, "2024-01-01T00:00:00", None), (2, "soon", "2024-01-01T00:00:00Z"), (3, None, "2024-02-30T00:00:00"), (4, None, None)]
    df = spark.createDataFrame(rows, "id bigint, start string, end string")
    assert sorted(r["id"] for r in labor.instant_rejects(df, "start", "end").collect()) == [2, 3]


def test_payroll_fields(spark):
    raw = [{"employeeId": "1", "total": "0", "amount": "5"}, {"EmployeeId": "2", "wage": "7.5"}, {"employeeId": "3"}, {"total": "9"}, {"employeeId": "4", "cost": "much"}]
    df = spark.createDataFrame([(x, 100, None) for x in raw], "fields map<string,string>, department_id bigint, day date")
    found = [(r["employee_id"], r["cost"]) for r in labor.resolve_payroll_fields(df).collect()]
    assert found == [(1, 0), (2, Decimal("7.5")), (3, 0), (None, 9), (4, 0)]


def test_department_label_of_null(spark, depts):
    df = shifts(spark, [(1, None, 0, 3600), (1, 5, 0, 3600), (1, 100, 0, 54)])
    found = {r["department"]: (r["total_hours"], r["total_cost"]) for r in labor.labor_by_department(df, depts).collect()}
    assert found == {"null → UNKNOWN": (1, 160), "5 → UNKNOWN": (1, 160), "100 → s0": (Decimal("0.0150"), Decimal("2.40"))}


@pytest.mark.parametrize(("ms", "want"), [(450_000, "0.13"), (54_000, "0.01"), (3_618_000, "1.00"), (-450_000, "-0.13"), (0, "0.00"), (3_600_000, "1.00")])
def test_hours_text(spark, ms, want):
    assert spark.range(1).select(numbers.hours_text(F.lit(ms).cast("bigint"))).first()[0] == want


def test_half_up(spark):
    assert [r[0] for r in spark.createDataFrame([(-2.5,), (2.5,), (-2.6,)], "x double").select(numbers.round_half_up(F.col("x"))).collect()] == [-2, 3, -3]


def test_midnights_on_days_of_clock_changes(spark):
    df = spark.createDataFrame([("2026-03-29",), ("2026-10-25",), ("2026-06-01",)], "d string").select(F.to_date("d").alias("d"))
    rows = df.select(clock.local_midnight(F.col("d")), clock.local_midnight(F.col("d"), mode="noon_offset")).collect()
    assert [tuple(x.strftime("%d %H") for x in r) for r in rows] == [("28 23", "28 22"), ("24 22", "24 23"), ("31 22", "31 22")]


def test_instants(spark):
    df = spark.createDataFrame([("2024-03-01T08:00:00Z",), ("2024-03-01T08:00:00",), ("2024-03-01T08:00:00+02:00",), ("nonsense",), (None,)], "t string")
    got = [r[0].hour if r[0] else None for r in df.select(clock.instant(F.col("t"), "Europe/Copenhagen")).collect()]
    assert got == [8, 7, 6, None, None]


def test_names(spark):
    df = spark.createDataFrame([("NØRREBRO",), (None,)], "n string")
    assert [r[0] for r in df.select(text.folded(F.col("n"))).collect()] == ["norrebro", None]
    assert [r[0] for r in df.select(text.product_matches(F.col("n"), "Bro")).collect()] == [True, False]


def test_dimensions_are_broadcast_and_no_python_runs(spark, depts):
    df = shifts(spark, [(1, 100, 0, 3600)])
    plan = labor.labor_by_store_hybrid(df, payroll(spark, [(1, "1")]), depts)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
