"""Reconciliation of source and warehouse counts, and the pipeline's health from its run logs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import status_for
from souk.plans import models
from souk.sources import marketplace as raw
from souk.sources.runlog import RunLog

# Fixed thresholds: hours (or, for malformed records, the rate) from which a metric warns or fails.
LIMITS = {"extract": (3.0, 6.0), "stream": (1.0, 3.0), "clean": (2.0, 6.0), "malformed": (0.02, 0.10)}
#: The end of the last extract window, and the instant of the snapshot.
WATERMARK = datetime(2001, 1, 1)
NOW = datetime(2024, 1, 31)


def compare_series(source: DataFrame, warehouse: DataFrame, entity: str, grain: str) -> DataFrame:
    """Two (check_date, n) series side by side, by the union of their keys; a total has the key NULL."""
    s, w = source.select("check_date", F.col("n").alias("s")), warehouse.select(F.col("check_date").alias("_date"), F.col("n").alias("w"))
    joined = s.join(w, F.col("check_date").eqNullSafe(F.col("_date")), "full")
    counts = joined.select(F.lit(entity).alias("entity"), F.lit(grain).alias("grain"), F.coalesce("check_date", "_date").alias("check_date"), F.coalesce("s", F.lit(0)).cast("long").alias("source_count"), F.coalesce("w", F.lit(0)).cast("long").alias("warehouse_count"))
    return counts.withColumn("difference", F.col("source_count") - F.col("warehouse_count")).withColumn("status", F.when(F.col("difference") == 0, "ok").otherwise("mismatch"))


def _by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.to_date("created_at").alias("check_date")).agg(F.count(F.lit(1)).alias("n"))


def _total(rows: DataFrame, key: str | None = None) -> DataFrame:
    return rows.agg((F.count_distinct(key) if key else F.count(F.lit(1))).alias("n")).select(F.lit(None).cast("date").alias("check_date"), "n")


def bounded_series(source: DataFrame, warehouse: Callable[[], DataFrame], entity: str, watermark: datetime | None) -> DataFrame | None:
    """Rows by day up to the end of the last extract; None where there was none, and so nothing to hold against.

    The bound is a literal, so both scans are pruned by it. The warehouse is read only where there is a bound.
    """
    if watermark is None:
        return None
    bound = F.col("updated_at") <= F.lit(watermark)
    return compare_series(_by_day(source.where(bound)), _by_day(warehouse().where(bound)), entity, "day")


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All checks: facts by day, dimensions and events in total. Sources count up to the extract's watermark."""
    checked = F.lit(NOW).alias("checked_at")
    before = F.col("created_at") < F.lit(WATERMARK)
    parts = [compare_series(_by_day(source(spark, folder).where(before)), _by_day(fact(spark, folder)), name, "day") for name, source, fact in (("orders", raw.orders, models.fct_orders), ("order_items", raw.order_items, models.fct_order_items), ("payments", raw.payments, models.fct_payments))]
    parts += [compare_series(_total(source(spark, folder).where(before)), _total(dim(spark, folder), key), name, "total") for name, source, dim, key in (("users", raw.users, models.dim_users, "user_id"), ("products", raw.products, models.dim_products, "product_id"), ("sellers", raw.sellers, models.dim_sellers, "seller_id"), ("categories", raw.categories, models.dim_categories, "category_id"))]
    parts.append(compare_series(_total(raw.raw_events(spark, folder), "event_id"), _total(models.fct_events(spark, folder)), "events", "total"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select(checked, "*")


def _age(then, now: datetime):
    """Hours since an instant, two digits; without a run infinitely many."""
    hours = F.round((F.unix_micros(F.lit(now)) - F.unix_micros(then)) / 3_600_000_000.0, 2)
    return F.coalesce(hours, F.lit(float("inf")))


def _metric(component: str, entity, metric: str, value, status) -> list:
    limits = LIMITS.get(component)
    if status is None:
        status = status_for(value, *map(F.lit, limits))
    return [F.lit(component).alias("component"), entity.alias("entity"), F.lit(metric).alias("metric"), value.cast("double").alias("metric_value"), (F.lit(status) if isinstance(status, str) else status).alias("status")]


def health(log: RunLog, counts: DataFrame, now: datetime) -> DataFrame:
    """The health snapshot, from the log of runs and the newest counts. Malformed records are counted, but judged by their rate."""
    extract = log.of("extract")
    stream = log.of("stream", "records", "malformed")
    clean = log.of("clean", "input_rows", "duplicates_removed")
    since = F.lit(now) - F.expr("INTERVAL 24 HOURS")
    none = F.lit("")
    last = extract.groupBy("entity").agg(F.max("recorded_at").alias("last"))
    s = stream.where(F.col("started_at") >= since).agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("malformed"), F.lit(0)).alias("malformed"), F.max("started_at").alias("last"))
    c = clean.where(F.col("recorded_at") >= since).agg(F.coalesce(F.sum("input_rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("duplicates_removed"), F.lit(0)).alias("duplicates"), F.max("recorded_at").alias("last"))
    r = counts.agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") != "ok").alias("failed"))
    rate = F.coalesce(F.try_divide(F.col("malformed"), F.col("records")), F.lit(0.0))
    parts = [
        last.select(*_metric("extract", F.col("entity"), "last_run_age_hours", _age(F.col("last"), now), None)),
        s.select(*_metric("stream", none, "records_last_24h", F.col("records"), "ok")),
        s.select(*_metric("stream", none, "malformed_last_24h", F.col("malformed"), status_for(rate, *map(F.lit, LIMITS["malformed"])))),
        s.select(*_metric("stream", none, "last_run_age_hours", _age(F.col("last"), now), None)),
        c.select(*_metric("clean", none, "rows_cleaned_last_24h", F.col("rows"), "ok")),
        c.select(*_metric("clean", none, "duplicates_removed_last_24h", F.col("duplicates"), "ok")),
        c.select(*_metric("clean", none, "last_run_age_hours", _age(F.col("last"), now), None)),
        r.select(*_metric("reconcile", none, "checks_run", F.col("checks"), "ok")),
        r.select(*_metric("reconcile", none, "checks_failed", F.col("failed"), F.when(F.col("failed") > 0, "error").otherwise("ok"))),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select(F.lit(now).alias("checked_at"), "*")


def latest(snapshots: DataFrame) -> DataFrame:
    """The rows of the newest snapshot, in one pass: a snapshot (a row for each check and day) travels as one value."""
    rest = [c for c in snapshots.columns if c != "checked_at"]
    each = snapshots.groupBy("checked_at").agg(F.collect_list(F.struct(*rest)).alias("found"))
    newest = each.agg(F.max("checked_at").alias("checked_at"), F.max_by("found", "checked_at").alias("found"))
    return newest.select("checked_at", F.inline("found"))


class Snapshots:
    """Stored snapshots of checks or metrics: append-only, a run's rows share their instant."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def newest(self) -> DataFrame:
        """The newest snapshot; its instant is fetched first, so that it reaches the scan as a literal."""
        stored = self.spark.read.parquet(self.path)
        return stored.where(F.col("checked_at") == F.lit(stored.agg(F.max("checked_at")).collect()[0][0]))
