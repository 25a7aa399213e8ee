"""The dashboards' queries. Live ones take the instant that counts as now."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.columns import cents, half_up_ratio
from souk.plans import models, operations
from souk.sources import marketplace as raw
from souk.streaming import live

Card = Callable[..., DataFrame]
CARDS: dict[str, Card] = {}
#: What counts as now for the live cards, unless they are told (``now``).
NOW = datetime(2024, 1, 15, 12, 0)


def card(number: int, name: str) -> Callable[[Card], Card]:
    def keep(build: Card) -> Card:
        CARDS[f"card_{number:02d}_{name}"] = build
        return build

    return keep


def _gmv(spark, folder):
    return models.mart_daily_gmv(spark, folder)


@card(1, "total_gmv")
def _(spark, folder):
    return _gmv(spark, folder).agg(F.sum("gmv").cast("decimal(24,2)").alias("total_gmv"))


@card(2, "total_orders")
def _(spark, folder):
    return _gmv(spark, folder).agg(F.sum("orders").alias("total_orders"))


@card(3, "average_order_value")
def _(spark, folder):
    return _gmv(spark, folder).agg(half_up_ratio(cents(F.sum("gmv")), F.sum("orders") * 100, 2).alias("aov"))


@card(4, "active_buyers")
def _(spark, folder):
    return models.revenue_orders(models.fct_orders(spark, folder)).agg(F.count_distinct("user_id").alias("buyers"))


@card(5, "gmv_by_day")
def _(spark, folder):
    return _gmv(spark, folder).select("date_key", "gmv").orderBy("date_key")


@card(6, "orders_and_buyers_by_day")
def _(spark, folder):
    return _gmv(spark, folder).select("date_key", "orders", "buyers").orderBy("date_key")


@card(7, "top_categories")
def _(spark, folder):
    """Revenue by category before the names join."""
    sums = models.revenue_orders(models.fct_order_items(spark, folder)).groupBy("category_id").agg(F.sum("line_amount").cast("decimal(24,2)").alias("revenue"))
    names = models.dim_categories(spark, folder).select("category_id", F.col("category_name").alias("category"))
    return sums.join(names, "category_id").groupBy("category").agg(F.sum("revenue").cast("decimal(24,2)").alias("revenue")).orderBy(F.desc("revenue"), "category").limit(10)


@card(8, "top_sellers")
def _(spark, folder):
    return models.mart_seller_performance(spark, folder).orderBy(F.desc("revenue"), "seller_id").select("seller_name", "orders", "units_sold", "revenue").limit(10)


@card(9, "revenue_by_method")
def _(spark, folder):
    rows = models.fct_payments(spark, folder).where(F.col("payment_status").isin("captured", "refunded"))
    return rows.groupBy("payment_method").agg(F.sum("amount").cast("decimal(24,2)").alias("revenue"), F.count(F.lit(1)).alias("payments")).orderBy(F.desc("revenue"))


def _cohorts(spark, folder, *columns):
    return models.mart_cohort_retention(spark, folder).orderBy("cohort_month", "month_number").select(*columns)


@card(10, "cohort_retention")
def _(spark, folder):
    return _cohorts(spark, folder, "month_number", "cohort_month", "retention_rate")


@card(11, "cohort_table")
def _(spark, folder):
    return _cohorts(spark, folder, "cohort_month", "month_number", "active_users", "retention_rate")


@card(12, "new_customers")
def _(spark, folder):
    return models.mart_cohort_retention(spark, folder).where("month_number = 0").select("cohort_month", "cohort_size").orderBy("cohort_month")


@card(13, "repeat_rate")
def _(spark, folder):
    buyers = models.revenue_orders(models.fct_orders(spark, folder)).groupBy("user_id").agg(F.count(F.lit(1)).alias("orders"))
    return buyers.agg(half_up_ratio(F.count_if(F.col("orders") > 1), F.count(F.lit(1)), 4).alias("repeat_rate"))


@card(14, "revenue_by_city")
def _(spark, folder):
    rows = models.revenue_orders(models.fct_orders(spark, folder)).groupBy("shipping_city")
    return rows.agg(F.sum("total_amount").cast("decimal(24,2)").alias("revenue"), F.count(F.lit(1)).alias("orders")).orderBy(F.desc("revenue"))


@card(15, "funnel")
def _(spark, folder):
    return models.mart_funnel_steps(spark, folder).orderBy("step_order").select("step", "sessions")


@card(16, "funnel_conversion")
def _(spark, folder):
    return models.mart_funnel_steps(spark, folder).orderBy("step_order").select("step", "sessions", "share_of_entry", "step_conversion_rate")


@card(17, "daily_conversion")
def _(spark, folder):
    return models.mart_funnel_daily(spark, folder).orderBy("event_date").select("event_date", "view_to_cart_rate", "cart_to_checkout_rate", "checkout_to_purchase_rate")


def _recent(rows: DataFrame, column: str, minutes: int, now: datetime) -> DataFrame:
    return rows.where(F.col(column) >= F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES"))


@card(18, "live_purchases")
def _(spark, folder, now=NOW):
    return _recent(live.orders_per_minute(live.live_events(raw.sent_events(spark, folder))), "minute", 30, now).orderBy("minute")


@card(19, "live_events")
def _(spark, folder, now=NOW):
    return _recent(live.events_per_minute(live.live_events(raw.sent_events(spark, folder))), "minute", 30, now).orderBy("minute", "event_type")


@card(20, "live_funnel")
def _(spark, folder):
    """One pass over the events instead of one for each step; steps without events count 0."""
    return models.funnel_steps_of(live.live_events(raw.sent_events(spark, folder))).select("step", "sessions")


@card(21, "live_sessions")
def _(spark, folder, now=NOW):
    return _recent(live.live_events(raw.sent_events(spark, folder)), "event_time", 15, now).agg(F.count_distinct("session_id").alias("sessions"))


@card(22, "checks_failing")
def _(spark, folder):
    return operations.stored(spark, folder, "health").agg(F.count_if(F.col("status") != "ok").alias("failing"))


@card(23, "mismatches")
def _(spark, folder):
    return operations.stored(spark, folder, "counts").agg(F.count_if(F.col("difference") != 0).alias("mismatches"))


@card(24, "dead_lettered")
def _(spark, folder):
    return operations.stored(spark, folder, "health").where("metric = 'malformed_last_24h'").select(F.col("metric_value").alias("malformed_last_24h"))


@card(25, "extract_freshness")
def _(spark, folder):
    rows = operations.stored(spark, folder, "health").where("component = 'extract' AND metric = 'last_run_age_hours'")
    return rows.select("entity", F.col("metric_value").alias("hours_since_last_run")).orderBy(F.desc("hours_since_last_run"))


@card(26, "reconciliation")
def _(spark, folder):
    rows = operations.stored(spark, folder, "counts").groupBy("entity", "grain")
    return rows.agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("difference") != 0).alias("mismatched"), F.sum(F.abs("difference")).alias("total_abs_difference")).orderBy(F.desc("mismatched"), "entity")


@card(27, "health")
def _(spark, folder):
    return operations.stored(spark, folder, "health").select("component", "entity", "metric", "metric_value", "status").orderBy(F.desc("status"), "component", "entity", "metric")


@card(28, "reconciliation_mismatches")
def _(spark, folder):
    rows = operations.stored(spark, folder, "counts").where("difference <> 0")
    return rows.select("entity", "grain", "check_date", "source_count", "warehouse_count", "difference", "status").orderBy(F.desc(F.abs("difference")))
