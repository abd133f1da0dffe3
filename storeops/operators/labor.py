"""Hours and labor cost by shift, department and store."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from storeops.functions.clock import instant
from storeops.functions.numbers import HOURLY_RATE, cost, duration_ms, hours, hours_text, round_half_up, whole_cost
from storeops.functions.text import dept_label
from storeops.sources.folders import work_folder

#: Shifts of one list, about.
LIST = 10_000
#: Fields under which a payroll row may have its employee and its cost, the first present one counts.
EMPLOYEE_FIELDS = ("employeeId", "EmployeeId")
COST_FIELDS = ("totalCost", "total", "amount", "salaryAmount", "cost", "salary", "wage")


def shift_hours(shifts: DataFrame, missing: str = "null") -> DataFrame:
    """Adds ``ms``; a missing start or end gives null, or 0 with ``missing='zero'``."""
    ms = duration_ms(F.col("start_dt"), F.col("end_dt"))
    return shifts.withColumn("ms", F.coalesce(ms, F.lit(0).cast("bigint")) if missing == "zero" else ms)


def instant_rejects(rows: DataFrame, *texts: str, source_tz: str = "UTC") -> DataFrame:
    """Rows of which some date-time text is there but can't be parsed; elsewhere those count as missing."""
    bad = [F.col(c).isNotNull() & instant(F.col(c), source_tz).isNull() for c in texts]
    return rows.filter(reduce(Column.__or__, bad))


def shifts_in_range(shifts: DataFrame, first: str, last: str) -> DataFrame:
    """Shifts that start on one of the days from first to last, both included."""
    start = F.col("start_dt")
    return shifts.filter((start >= F.lit(first).cast("date")) & (start < F.date_add(F.lit(last).cast("date"), 1)))


def resolve_payroll_fields(raw: DataFrame) -> DataFrame:
    """(employee_id, cost, department_id, day) of rows whose ``fields`` is a map of the raw object.

    A field that is there counts even if it is 0; a row without any cost costs
    0; a cost or id that is no number is null, like a missing one.
    """
    first = lambda names, kind: F.coalesce(*(F.col("fields")[n].try_cast(kind) for n in names))
    return raw.select(
        first(EMPLOYEE_FIELDS, "bigint").alias("employee_id"),
        F.coalesce(first(COST_FIELDS, "decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).alias("cost"),
        "department_id",
        "day",
    )


def drop_null_employee(df: DataFrame) -> DataFrame:
    return df.filter(F.col("employee_id").isNotNull())


def payroll_in_range(payroll: DataFrame, dept_dim: DataFrame, first: str, last: str) -> DataFrame:
    """Payroll of the days from first to last, of departments that have a store."""
    return payroll_semi_dept(payroll.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))), dept_dim)


def payroll_semi_dept(payroll: DataFrame, dept_dim: DataFrame) -> DataFrame:
    return payroll.join(F.broadcast(dept_dim), "department_id", "left_semi")


def shifts_left_store(shifts: DataFrame, dept_dim: DataFrame) -> DataFrame:
    """With ``store_id``, null where the department has no store. The dimension has a row for each of a few departments."""
    return shifts.join(F.broadcast(dept_dim), "department_id", "left")


def shifts_inner_store(shifts: DataFrame, dept_dim: DataFrame) -> DataFrame:
    return shifts.join(F.broadcast(dept_dim), "department_id")


def unmatched_shifts(shifts: DataFrame, dept_dim: DataFrame) -> DataFrame:
    return shifts.join(F.broadcast(dept_dim), "department_id", "left_anti")


def cost_per_employee(payroll: DataFrame) -> DataFrame:
    total = F.sum("cost").cast("decimal(18,2)").alias("cost")
    return drop_null_employee(payroll).groupBy("employee_id").agg(total)


def shifts_per_employee(shifts: DataFrame, longest: int = LIST) -> DataFrame:
    """The departments and milliseconds of each employee's shifts, in order of shift.

    An employee with more than ``longest`` shifts has several lists, numbered
    by ``part``: id modulo their number, so that none grows with the data.
    """
    held = drop_null_employee(shift_hours(shifts, "zero"))
    counts = held.groupBy("employee_id").agg(F.ceil(F.count(F.lit(1)) / longest).alias("parts"))
    item = F.struct("id", "department_id", "ms")
    rows = held.join(counts, "employee_id").withColumn("part", F.pmod("id", "parts"))
    return rows.groupBy("employee_id", "part").agg(F.array_sort(F.collect_list(item)).alias("shifts"))


def shifts_left_payroll(shifts: DataFrame, payroll: DataFrame) -> DataFrame:
    """Shifts with the employee's payroll cost or null; employees without shifts go."""
    return drop_null_employee(shifts).join(cost_per_employee(payroll), "employee_id", "left")


def with_employee_totals(shifts: DataFrame) -> DataFrame:
    """Adds ``emp_ms`` and ``emp_shifts``, over all shifts of the employee.

    Totals are aggregated before they are shuffled and joined back, so an
    employee with very many shifts is no hot window.
    """
    held = drop_null_employee(shift_hours(shifts, "zero"))
    totals = held.groupBy("employee_id").agg(F.sum("ms").alias("emp_ms"), F.count(F.lit(1)).alias("emp_shifts"))
    return held.join(totals, "employee_id")


def alloc_share() -> Column:
    """Share of the employee's cost that a shift gets: by hours, or equal where the hours don't sum to more than 0."""
    return F.when(F.col("emp_ms") > 0, F.col("ms") / F.col("emp_ms")).otherwise(F.lit(1.0) / F.col("emp_shifts"))


def labor_by_store_hybrid(shifts: DataFrame, payroll: DataFrame, dept_dim: DataFrame, rate: int = HOURLY_RATE) -> DataFrame:
    """Cost by store: payroll where the employee has some, else hours at the rate; allocated by share, rounded once."""
    return allocated(shifts, cost_per_employee(payroll), dept_dim, rate)


def allocated(shifts: DataFrame, costs: DataFrame, dept_dim: DataFrame, rate: int) -> DataFrame:
    """Cost by store from the payroll cost of employees."""
    rows = with_employee_totals(shifts).withColumn("share", alloc_share())
    rows = rows.join(costs, "employee_id", "left")
    hourly = F.col("emp_ms") * rate / F.lit(3_600_000.0)
    amount = F.coalesce(F.col("cost").cast("double"), hourly) * F.col("share")
    return shifts_inner_store(rows, dept_dim).groupBy("store_id").agg(round_half_up(F.sum(amount)).alias("labor_cost"))


def labor_by_store_counted(shifts: DataFrame, payroll: DataFrame, dept_dim: DataFrame, rate: int = HOURLY_RATE, folder: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(cost by store, counters) of one run: what the report leaves out is counted while it is made, without a second reading.

    Counters: ``shifts`` and of them ``no_employee``, ``no_times`` (a start or
    end missing), ``unmatched`` (no store for the department); ``salaried`` and
    ``hourly`` employees with shifts. The rows lie in a work folder.
    """
    spark = shifts.sparkSession
    at = f"{folder or work_folder(spark, 'labor')}/by-store-{uuid.uuid4().hex}"
    read, people, dealt = Observation(), Observation(), Observation()
    missing = F.col("start_dt").isNull() | F.col("end_dt").isNull()
    seen = shifts.observe(read, F.count(F.lit(1)).alias("shifts"), F.count_if(F.col("employee_id").isNull()).alias("no_employee"), F.count_if(missing).alias("no_times"))
    held = drop_null_employee(shift_hours(seen, "zero"))
    totals = drop_null_employee(shift_hours(shifts, "zero")).groupBy("employee_id").agg(F.sum("ms").alias("emp_ms"), F.count(F.lit(1)).alias("emp_shifts"))
    totals = totals.join(cost_per_employee(payroll), "employee_id", "left")
    totals = totals.observe(people, F.count_if(F.col("cost").isNotNull()).alias("salaried"), F.count_if(F.col("cost").isNull()).alias("hourly"))
    rows = shifts_left_store(held.join(totals, "employee_id"), dept_dim)
    rows = rows.observe(dealt, F.count_if(F.col("store_id").isNull()).alias("unmatched"))
    amount = F.coalesce(F.col("cost").cast("double"), F.col("emp_ms") * rate / F.lit(3_600_000.0)) * alloc_share()
    # Unmatched shifts are dropped after they are counted.
    by_store = rows.groupBy("store_id").agg(round_half_up(F.sum(amount)).alias("labor_cost")).filter("store_id is not null")
    by_store.write.parquet(at)
    return spark.read.schema(by_store.schema).parquet(at), {**read.get, **people.get, **dealt.get}


def labor_by_store_hourly(shifts: DataFrame, dept_dim: DataFrame, rate: int = HOURLY_RATE) -> DataFrame:
    """Cost by store at the rate, each shift rounded."""
    rows = shifts_inner_store(shift_hours(shifts, "zero"), dept_dim)
    return rows.groupBy("store_id").agg(F.sum(whole_cost(F.col("ms"), rate)).alias("labor_cost"))


def labor_by_store(shifts: DataFrame, payroll: Callable[[], DataFrame], dept_dim: DataFrame, folder: str | None = None, rate: int = HOURLY_RATE) -> DataFrame:
    """Hybrid, or hourly where the payroll can't be read; an empty payroll is one that can.

    ``payroll`` opens the source. It is read once, to the end, into a work
    folder of this run, so that a source that breaks while it is read counts
    as unreadable too. A folder that can't be written is no such case and
    raises, as does what is wrong with the shifts.
    """
    spark = shifts.sparkSession
    folder = folder or work_folder(spark, "labor")

    def probe() -> None:
        spark.range(1).write.mode("overwrite").parquet(f"{folder}/probe")

    def hourly(e: Exception) -> DataFrame:
        warnings.warn(f"labor cost falls back to hours, since the payroll can't be read: {e}", stacklevel=3)
        return labor_by_store_hourly(shifts, dept_dim, rate)

    probe()
    try:
        source = payroll()
    except Exception as e:  # whatever the source's own code raises
        return hourly(e)
    costs = cost_per_employee(source)
    at = f"{folder}/costs-{uuid.uuid4().hex}"
    try:
        costs.write.parquet(at)
    except (PySparkException, Py4JError) as e:
        probe()  # if it is the folder that broke, this raises
        return hourly(e)
    return allocated(shifts, spark.read.schema(costs.schema).parquet(at), dept_dim, rate)


def labor_counters(shifts: DataFrame, payroll: DataFrame, dept_dim: DataFrame) -> DataFrame:
    """One row: salaried and hourly employees with shifts, shift rows without store, employees with payroll."""
    rows = shifts_left_store(shifts_left_payroll(shifts, payroll), dept_dim)
    some = rows.agg(
        F.count_distinct(F.when(F.col("cost").isNotNull(), F.col("employee_id"))).alias("salaried"),
        F.count_distinct(F.when(F.col("cost").isNull(), F.col("employee_id"))).alias("hourly"),
        F.count_if(F.col("store_id").isNull()).alias("unmatched"),
    )
    other = payroll_employees(payroll).agg(F.count(F.lit(1)).alias("with_payroll"))
    both = some.unionByName(other, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def payroll_employees(payroll: DataFrame) -> DataFrame:
    return drop_null_employee(payroll).select("employee_id").distinct()


def shift_report(shifts: DataFrame, dept_dim: DataFrame, rate: int = HOURLY_RATE) -> DataFrame:
    """A row for each shift: hours to 4 places, the rate, cost to 2 places, field names of the source row."""
    names = shifts.columns
    rows = shifts_left_store(shift_hours(shifts), dept_dim)
    return rows.select(
        F.col("id").alias("shift_id"),
        "employee_id",
        "department_id",
        "store_id",
        "start_dt",
        "end_dt",
        hours(F.col("ms")).alias("hours"),
        F.lit(rate).cast("bigint").alias("pay_rate"),
        cost(F.col("ms"), rate).alias("cost"),
        F.array(*map(F.lit, names)).alias("raw_fields"),
    )


def labor_by_department(shifts: DataFrame, dept_dim: DataFrame, rate: int = HOURLY_RATE) -> DataFrame:
    """Count, hours and cost by department label; sums of the shifts' rounded values."""
    rows = shifts_left_store(shift_hours(shifts), dept_dim)
    rows = rows.select("department_id", "store_id", hours(F.col("ms")).alias("hours"), cost(F.col("ms"), rate).alias("cost"))
    return rows.groupBy(dept_label(F.col("department_id"), F.col("store_id")).alias("department")).agg(
        F.count(F.lit(1)).alias("shift_count"),
        F.coalesce(F.sum("hours"), F.lit(0)).cast("decimal(18,4)").alias("total_hours"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(18,2)").alias("total_cost"),
    )


def labor_summary(shifts: DataFrame, rate: int = HOURLY_RATE) -> DataFrame:
    return shifts.agg(F.count(F.lit(1)).alias("total_shifts")).withColumn("hourly_rate", F.lit(rate).cast("bigint"))


def annotate_shifts(shifts: DataFrame) -> DataFrame:
    """All columns and the hours as text with 2 places."""
    return shifts.withColumn("hours_text", hours_text(duration_ms(F.col("start_dt"), F.col("end_dt"))))


def first_row(df: DataFrame, by: str) -> DataFrame:
    """The row of smallest ``by``; one aggregation, no sort."""
    row = F.struct(*df.columns)
    return df.agg(F.min_by(row, by).alias("row")).filter("row is not null").select("row.*")
