"""The simulation keeps its rates, and what it makes goes through the engine."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from souk.sources import simulate
from souk.streaming.ingest import parse_events


def test_clickstream(spark):
    counts = simulate.hours(spark, datetime(2024, 1, 15, 0), 48, 200)
    got = counts.agg(F.sum("n").alias("n"), F.sum("expected").alias("e")).collect()[0]
    assert abs(got.n / got.e - 1) < 0.05
    stream = simulate.messages(simulate.instants(counts), 50, 100).cache()
    n = stream.count()
    assert 0.01 < stream.where("duplicate").count() / n < 0.03 and stream.where("malformed").count() / n < 0.012
    parsed = parse_events(stream.selectExpr("key", "value", "'t' topic", "0 partition", "0L offset", "timestamp")).cache()
    assert parsed.where("error IS NOT NULL").count() == stream.where("malformed").count()
    views = parsed.where("event_type = 'page_view' AND error IS NULL").count() / n
    assert 0.66 < views < 0.74
    assert {r.schema_version for r in parsed.where("error IS NULL").select("schema_version").distinct().collect()} == {1, 2}


def test_orders(spark):
    products = spark.range(50).select(F.col("id").alias("product_id"), (F.col("id") + 10).cast("decimal(14,2)").alias("price"))
    orders, items = simulate.orders(spark, 2000, 100, products, datetime(2024, 9, 1), 30)
    sums = items.groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("t"), F.count(F.lit(1)).alias("n"))
    joined = orders.join(sums, "order_id")
    assert joined.count() == 2000 and joined.where("t <> total_amount OR n NOT BETWEEN 1 AND 4").count() == 0
    assert 0.70 < orders.where("status = 'paid'").count() / 2000 < 0.80
    assert items.join(products, "product_id").where("unit_price > price OR unit_price < price * 0.69").count() == 0


def test_lifecycle_and_drift(spark):
    rows = spark.range(3000).select(simulate.uniform(1, "x", F.col("id")).alias("u"))
    moved = rows.select(simulate.next_status(F.lit("pending"), F.col("u")).alias("s"), simulate.next_status(F.lit("delivered"), F.col("u")).alias("d"), simulate.drift_price(F.lit(100).cast("decimal(14,2)"), F.col("u")).alias("p"))
    got = moved.agg(F.count_if(F.col("s") == "paid").alias("paid"), F.count_if(F.col("d") != "delivered").alias("bad"), F.min("p").alias("low"), F.max("p").alias("high")).collect()[0]
    assert 0.82 < got.paid / 3000 < 0.88 and got.bad == 0 and got.low >= 92 and got.high <= 108
    one = rows.limit(1).select(simulate.payment_status(F.lit("refunded")), simulate.payment_status(F.lit("shipped")), simulate.payment_status(F.lit("pending"))).collect()[0]
    assert tuple(one) == ("refunded", "captured", "pending")
