"""Staging models: the newest version of every raw row, typed and normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.columns import cents, half_up_ratio
from souk.operators.clean import clean_frame
from souk.operators.versions import latest_version
from souk.sources import marketplace as raw


def _both(build, spark: SparkSession, folder: str) -> DataFrame:
    """The append-only raw table: what was loaded first, and every row that changed since."""
    return build(spark, folder).unionByName(build(spark, folder, changed=True).where(F.col("updated_at") > F.col("created_at")))


def normal(column: str):
    return F.lower(F.trim(column))


def users_of(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", normal("email").alias("email"), F.trim("full_name").alias("full_name"), F.nullif(F.trim("phone"), F.lit("")).alias("phone"), F.trim("city").alias("city"), F.upper(F.trim("country")).alias("country_code"), "created_at", "updated_at")


def products_of(rows: DataFrame) -> DataFrame:
    return rows.select("product_id", "seller_id", "category_id", F.trim("name").alias("product_name"), "sku", "price", "cost", "stock", "is_active", half_up_ratio(cents(F.col("price") - F.col("cost")), cents(F.col("price")), 4).alias("gross_margin_ratio"), "created_at", "updated_at")


def stg_users(spark: SparkSession, folder: str) -> DataFrame:
    return users_of(latest_version(_both(raw.users, spark, folder), ["user_id"], "updated_at"))


def stg_products(spark: SparkSession, folder: str) -> DataFrame:
    return products_of(latest_version(_both(raw.products, spark, folder), ["product_id"], "updated_at"))


def stg_sellers(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_version(raw.sellers(spark, folder), ["seller_id"], "updated_at")
    return rows.select("seller_id", F.trim("name").alias("seller_name"), normal("email").alias("email"), F.trim("city").alias("city"), F.upper(F.trim("country")).alias("country_code"), "rating", "created_at", "updated_at")


def stg_categories(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_version(raw.categories(spark, folder), ["category_id"], "updated_at")
    return rows.select("category_id", F.trim("name").alias("category_name"), normal("slug").alias("slug"), "parent_category_id", "created_at", "updated_at")


def stg_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Terminal orders are judged by the normalised status."""
    rows = latest_version(raw.orders(spark, folder), ["order_id"], "updated_at").withColumn("status", normal("status"))
    return rows.select("order_id", "user_id", F.col("status").alias("order_status"), F.upper(F.trim("currency")).alias("currency"), F.trim("shipping_city").alias("shipping_city"), "total_amount", F.to_date("created_at").alias("order_date"), "created_at", "updated_at", F.col("status").isin(*raw.TERMINAL).alias("is_terminal"))


def order_items_of(rows: DataFrame, *more: str) -> DataFrame:
    rows = latest_version(rows, ["order_id", "order_item_id"], "updated_at")  # dealt by order already
    return rows.select("order_item_id", "order_id", "product_id", "quantity", "unit_price", (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)").alias("line_amount"), "created_at", "updated_at", *more)


def stg_order_items(spark: SparkSession, folder: str) -> DataFrame:
    return order_items_of(raw.order_items(spark, folder))


def stg_payments(spark: SparkSession, folder: str) -> DataFrame:
    rows = latest_version(raw.payments(spark, folder), ["payment_id"], "updated_at")
    return rows.select("payment_id", "order_id", normal("method").alias("payment_method"), "amount", normal("status").alias("payment_status"), "created_at", "updated_at")


def stg_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean_frame(raw.raw_events(spark, folder))
    day_hour = [F.to_date("event_time").alias("event_date"), F.date_trunc("hour", "event_time").alias("event_hour")]
    return rows.where("event_type <> ''").select("event_id", "schema_version", "event_type", "user_id", "session_id", "product_id", "event_time", *day_hour, "city", F.nullif("device_type", F.lit("")).alias("device_type"), F.nullif("platform_version", F.lit("")).alias("platform_version"), "consumed_at")
