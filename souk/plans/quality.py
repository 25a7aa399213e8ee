"""The marketplace's declared tests and source freshness, differences of keys, and histories from change logs, as queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import status_for
from souk.operators import declared
from souk.operators.declared import DataTest, declare
from souk.operators.difference import key_difference
from souk.operators.versions import scd2_from_changes, scd2_merge_changes, scd2_versions
from souk.plans import models, staging
from souk.plans.store import store_of
from souk.sources import marketplace as raw

KEY, HERE = ["unique", "not_null"], ["not_null"]
# What statuses, methods and steps there are.
STATUSES = ["pending", "paid", "shipped", "delivered", "cancelled", "refunded"]
PAYMENT_STATUSES = ["pending", "authorized", "captured", "failed", "refunded"]
METHODS, STEPS = list(raw.METHODS.values()), list(raw.FUNNEL)
#: Which tests each model's columns are held to.
DECLARED: dict[str, dict[str, list]] = {
    "stg_users": {"user_id": KEY, "email": HERE, "city": HERE},
    "stg_sellers": {"seller_id": KEY, "email": KEY, "rating": HERE},
    "stg_events": {"event_id": KEY, "event_type": [*HERE, STEPS], "user_id": HERE, "session_id": HERE, "event_time": HERE, "schema_version": [[1, 2]]},
    "stg_categories": {"category_id": KEY, "slug": KEY, "parent_category_id": [("stg_categories", "category_id")]},
    "stg_products": {"product_id": KEY, "sku": KEY, "seller_id": [*HERE, ("stg_sellers", "seller_id")], "category_id": [*HERE, ("stg_categories", "category_id")], "price": HERE},
    "stg_orders": {"order_id": KEY, "user_id": [*HERE, ("stg_users", "user_id")], "order_status": [*HERE, STATUSES], "total_amount": HERE},
    "stg_order_items": {"order_item_id": KEY, "order_id": [*HERE, ("stg_orders", "order_id")], "product_id": [*HERE, ("stg_products", "product_id")], "quantity": HERE},
    "stg_payments": {"payment_id": KEY, "order_id": [*HERE, ("stg_orders", "order_id")], "payment_method": [METHODS], "payment_status": [PAYMENT_STATUSES]},
    "dim_users": {"user_sk": KEY, "user_id": HERE, "valid_from": HERE},
    "dim_products": {"product_sk": KEY, "product_id": HERE, "price": HERE},
    "dim_sellers": {"seller_sk": KEY, "seller_id": KEY},
    "dim_categories": {"category_sk": KEY, "category_id": KEY, "parent_category_id": [("dim_categories", "category_id")]},
    "dim_date": {"date_key": KEY},
    "fct_orders": {"order_id": KEY, "user_id": [*HERE, ("stg_users", "user_id")], "user_sk": [*HERE, ("dim_users", "user_sk")], "order_status": [STATUSES], "total_amount": HERE},
    "fct_order_items": {"order_item_id": KEY, "order_id": [*HERE, ("fct_orders", "order_id")], "product_id": HERE, "line_amount": HERE},
    "fct_payments": {"payment_id": KEY, "order_id": [*HERE, ("fct_orders", "order_id")], "payment_status": [PAYMENT_STATUSES]},
    "fct_events": {"event_id": KEY, "event_type": [*HERE, STEPS], "user_id": HERE, "session_id": HERE, "event_time": HERE, "event_date": HERE},
    "mart_daily_gmv": {"date_key": KEY, "gmv": HERE},
    "mart_cohort_retention": {"cohort_month": HERE, "retention_rate": HERE},
    "mart_seller_performance": {"seller_id": KEY, "revenue": HERE},
    "mart_funnel_daily": {"event_date": KEY, "page_view_sessions": HERE, "purchase_sessions": HERE},
    "mart_funnel_steps": {"step_order": KEY, "step": [*KEY, STEPS], "sessions": HERE, "share_of_entry": HERE},
}
TESTS: list[DataTest] = [t for model, columns in DECLARED.items() for t in declare(model, columns)]
# Fixed thresholds: for each source the column that dates it, and the hours after which it is late, or too late.
_DAY, _USUAL, _SLOW = 24.0, (48.0, 96.0), (14 * 24.0, 45 * 24.0)
FRESHNESS: dict[str, tuple[str, float, float]] = {
    **{t: ("updated_at", *_USUAL) for t in ("users", "products", "orders", "order_items", "payments")},
    **{t: ("updated_at", *_SLOW) for t in ("sellers", "categories")},
    "events": ("consumed_at", 3.0, 12.0),
}


def stored_models(spark: SparkSession, folder: str) -> declared.Models:
    """Models by name, each computed once and read by all of its tests."""
    store = store_of(spark, folder)
    # These are columns of stored tables, so they aren't stored again.
    seen = {"stg_order_items": models.staged_order_items, "fct_order_items": models.fct_order_items, "fct_events": models.fct_events}

    def model(name: str) -> DataFrame:
        if name in seen:
            return seen[name](spark, folder)
        return store.table(name, lambda: getattr(staging if name.startswith("stg_") else models, name)(spark, folder))

    return model


def dq_declared(spark: SparkSession, folder: str) -> DataFrame:
    return declared.report(stored_models(spark, folder), TESTS)


def source_freshness(sources: dict[str, DataFrame], limits: dict[str, tuple[str, float, float]], now: datetime) -> DataFrame:
    """(source, newest, age_hours, status) of each source by its own column and thresholds; an empty one is infinitely old."""
    found = None
    for name, (column, warn, error) in limits.items():
        newest = sources[name].agg(F.max(column).alias("newest"))
        age = F.coalesce(F.round((F.unix_micros(F.lit(now)) - F.unix_micros("newest")) / 3_600_000_000.0, 2), F.lit(float("inf")))
        row = newest.select(F.lit(name).alias("source"), "newest", age.alias("age_hours")).withColumn("status", status_for(F.col("age_hours"), F.lit(warn), F.lit(error)))
        found = row if found is None else found.unionByName(row)
    return found


def dq_source_freshness(spark: SparkSession, folder: str) -> DataFrame:
    sources = {name: getattr(raw, "raw_events" if name == "events" else name)(spark, folder) for name in FRESHNESS}
    return source_freshness(sources, FRESHNESS, datetime(1998, 8, 4))


def lost_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A warehouse of orders that lost some, has some twice, and some that were never there."""
    rows = raw.read(spark, folder, "orders").select("o_orderkey")
    copies = F.when((F.col("o_orderkey") % 997 == 5) & (F.col("o_orderkey") % 2 == 0), 0).when(F.col("o_orderkey") % 1999 == 7, 3).otherwise(1)
    strange = rows.where("o_orderkey % 2999 = 1").select((-F.col("o_orderkey") - 1).alias("o_orderkey"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))))).where(copies > 0).select("o_orderkey").unionByName(strange)


def order_key_difference(spark: SparkSession, folder: str) -> DataFrame:
    return key_difference(raw.read(spark, folder, "orders").select("o_orderkey"), lost_orders(spark, folder), "o_orderkey", 256)


def user_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a log of changes to what a user does; an error removes the user until the next event."""
    rows = raw.read(spark, folder, "events")
    return rows.select("user_id", F.col("ts").cast("timestamp").alias("changed_at"), F.col("event_id").alias("sequence"), F.col("event_type").alias("state"), (F.col("value") >= 50).alias("large"), (F.col("event_type") == "error").alias("removed"))


def scd2_from_changelog(spark: SparkSession, folder: str) -> DataFrame:
    """The whole log's history, told in three runs: what came in time up to an instant, late changes of before, the rest."""
    log, columns = user_changes(spark, folder), ["state", "large"]
    late, early = F.col("sequence") % 33 == 0, F.col("changed_at") < F.lit(datetime(2024, 1, 16))
    told = scd2_from_changes(log.where(early & ~late), "user_id", "changed_at", columns, "sequence", "removed")
    for more in (log.where(early & late), log.where(~early)):
        told = scd2_merge_changes(told, more, "user_id", "changed_at", columns, "sequence", "removed")
    return scd2_versions(told, "user_id", columns)
