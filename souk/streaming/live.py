"""The live path: events as they arrive, once each, and their per-minute views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from souk.operators.versions import latest_version
from souk.sources.marketplace import FUNNEL


def instant(column: str, now: Column) -> Column:
    """A text as an instant: as it stands, else without its zone letter, else the present (better than 1970)."""
    return F.coalesce(F.try_to_timestamp(column), F.try_to_timestamp(F.replace(column, F.lit("Z"), F.lit(""))), now)


def live_rows(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed rows with an id and one of the funnel's types, written exactly so. A time that can't be read is ``now``."""
    time = F.col("event_time") if raw.schema["event_time"].dataType != StringType() else instant("event_time", F.current_timestamp() if now is None else now)
    return raw.select(
        "event_id", time.cast("timestamp").alias("event_time"), "event_type", F.coalesce(F.col("user_id").cast("string").try_cast("long"), F.lit(0)).alias("user_id"),
        "session_id", "city", F.coalesce("device_type", "device").alias("device_type"), F.col("consumed_at").alias("ingested_at"),
    ).where(F.col("event_id").isNotNull() & (F.col("event_id") != "") & F.col("event_type").isin(*FUNNEL))


def live_events(raw: DataFrame) -> DataFrame:
    """Each event once, by its newest delivery, so that a redelivery changes no count."""
    return latest_version(live_rows(raw), ["event_id"], "ingested_at")


def live_stream(raw: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """The same of a stream, by the first delivery: ids are remembered for as long as events may be late."""
    return live_rows(raw).withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["event_id"])


def events_per_minute(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("minute", "event_time").alias("minute"), "event_type").agg(F.count(F.lit(1)).alias("events"))


def orders_per_minute(events: DataFrame) -> DataFrame:
    rows = events.where("event_type = 'purchase'")
    return rows.groupBy(F.date_trunc("minute", "event_time").alias("minute")).agg(F.count(F.lit(1)).alias("orders"))


def stream_per_minute(events: DataFrame) -> DataFrame:
    """Tumbling windows of a stream, for the update or complete mode."""
    counts = events.groupBy(F.window("event_time", "1 minute"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.col("window.start").alias("minute"), "event_type", "events")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there into an in-memory table (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
