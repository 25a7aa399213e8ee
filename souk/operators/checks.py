"""Data tests: each returns the rows that violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_unique(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def is_null(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNull())


def not_accepted(rows: DataFrame, column: str, values: tuple) -> DataFrame:
    """Values outside the list with their counts; NULL is no violation."""
    return rows.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Children whose key no parent has; NULL keys are no violation."""
    keys = parent.select(F.col(key).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def column_report(rows: DataFrame, unique: tuple[str, ...] = (), present: tuple[str, ...] = (), accepted: dict[str, tuple] | None = None) -> DataFrame:
    """(check, column, failures) of many column tests in two passes at most: one aggregate for nulls and lists, one for each key."""
    sums = [F.count_if(F.col(c).isNull()).alias(f"not_null:{c}") for c in present]
    sums += [F.count_if(~F.col(c).isin(*v)).alias(f"accepted:{c}") for c, v in (accepted or {}).items()]
    names = [f"not_null:{c}" for c in present] + [f"accepted:{c}" for c in (accepted or {})]
    one = rows.agg(*sums).select(F.explode(F.array(*(F.struct(F.lit(n.split(":")[0]).alias("check"), F.lit(n.split(":")[1]).alias("column"), F.col(f"`{n}`").alias("failures")) for n in names))).alias("r")).select("r.*")
    for c in unique:
        one = one.unionByName(not_unique(rows, c).agg(F.count(F.lit(1)).alias("failures")).select(F.lit("unique").alias("check"), F.lit(c).alias("column"), "failures"))
    return one


def cohort_bounds(cohorts: DataFrame) -> DataFrame:
    rate = F.col("retention_rate")
    bad = (rate < 0) | (rate > 1.0001) | ((F.col("month_number") == 0) & (rate != 1)) | (F.col("active_users") > F.col("cohort_size"))
    return cohorts.where(bad)


def revenue_differs(orders: DataFrame, items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Revenue by orders and by lines, if they differ."""
    return orders.agg(F.sum("total_amount").alias("orders_revenue")).crossJoin(items.agg(F.sum("line_amount").alias("items_revenue"))).where(F.abs(F.col("orders_revenue") - F.col("items_revenue")) > tolerance)


def totals_differ(orders: DataFrame, items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Orders whose total isn't the sum of their lines; lines are summed before they meet orders."""
    sums = items.groupBy("order_id").agg(F.sum("line_amount").alias("items_total"))
    return orders.join(sums, "order_id").where(F.abs(F.col("total_amount") - F.col("items_total")) > tolerance).select("order_id", "total_amount", "items_total")


def funnel_widens(steps: DataFrame) -> DataFrame:
    """Steps with more sessions than the step before."""
    before = steps.select((F.col("step_order") + 1).alias("step_order"), F.col("sessions").alias("previous_sessions"))
    return steps.join(before, "step_order").where("sessions > previous_sessions").select("step_order", "sessions", "previous_sessions")


def funnel_out_of_bounds(days: DataFrame) -> DataFrame:
    rates = [c for c in days.columns if c.endswith("_rate")]
    outside = reduce(lambda a, b: a | b, (~F.col(c).between(0, 1) for c in rates))
    wider = (F.col("cart_sessions") > F.col("page_view_sessions")) | (F.col("checkout_sessions") > F.col("cart_sessions")) | (F.col("purchase_sessions") > F.col("checkout_sessions"))
    return days.where(F.coalesce(outside, F.lit(False)) | wider).drop("sessions")


def many_current(versions: DataFrame, key: str) -> DataFrame:
    return not_unique(versions.where("is_current"), key)


def dotted_names(frames: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(table, column) of names with a dot."""
    return [(t, c) for t, f in frames.items() for c in f.columns if "." in c]


def freshness(rows: DataFrame, column: str, now, warn_hours: float, error_hours: float) -> DataFrame:
    """(age_hours, status) of the newest row; no rows at all is an error."""
    from souk.functions import status_for

    age = F.round((F.unix_micros(F.lit(now)) - F.unix_micros(F.max(column))) / 3_600_000_000.0, 2)
    return rows.agg(F.coalesce(age, F.lit(float("inf"))).alias("age_hours")).withColumn("status", status_for(F.col("age_hours"), F.lit(warn_hours), F.lit(error_hours)))
