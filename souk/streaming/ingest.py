"""At-least-once ingestion of JSON messages: typed events, and dead letters with the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
REQUIRED = ("event_id", "user_id", "event_type", "session_id", "event_time")
#: Messages of one hour that one task writes.
ROWS_OF_HOUR = 500_000
_FIELDS = (*REQUIRED, "schema_version", "product_id", "city", "device", "device_type", "platform_version")


def _typed(name: str, kind: str) -> Column:
    return F.try_variant_get("payload", f"$.{name}", kind)


def parse_events(messages: DataFrame) -> DataFrame:
    """Parse ``value``: the event's columns and ``error``, the first rule that it breaks (NULL for a good one).

    Rules in order: not empty, UTF-8, JSON, an object, required fields neither null nor empty (0 is a value),
    fields of the right type. Numbers are read as JSON numbers or as text of one; a fraction is cut for a
    number and refused for a text; true counts as 1.
    """
    text = F.try_validate_utf8(F.col("value").cast("string"))
    parsed = messages.withColumn("text", text).withColumn("payload", F.try_parse_json("text")).withColumn("kind", F.schema_of_variant("payload"))
    kind = F.col("kind")
    is_object = kind.startswith("OBJECT")
    numbers = ("user_id", "product_id", "schema_version")
    # Each field is taken out of the payload once, as a column that the rules below share.
    taken = {f"as_text_{c}": F.when(is_object, _typed(c, "string")) for c in _FIELDS}
    taken |= {f"shape_{c}": F.schema_of_variant(F.try_variant_get("payload", f"$.{c}", "variant")) for c in numbers}
    taken |= {f"as_number_{c}": _typed(c, "double") for c in numbers} | {f"as_flag_{c}": _typed(c, "boolean") for c in numbers}
    rows = parsed.withColumns(taken)
    field, shape = {c: F.col(f"as_text_{c}") for c in _FIELDS}, {c: F.col(f"shape_{c}") for c in numbers}

    def whole(name: str) -> Column:
        as_text = F.trim(field[name]).try_cast("long")
        number = F.col(f"as_number_{name}")
        cut = F.floor(F.abs(number)) * F.signum(number)
        return F.when(shape[name] == "STRING", as_text).when(shape[name] == "BOOLEAN", F.col(f"as_flag_{name}").cast("long")).otherwise(cut.cast("long"))

    def absent(name: str) -> Column:
        return field[name].isNull() | (field[name] == "")

    missing = F.array_compact(F.array(*(F.when(absent(c), F.lit(c)) for c in REQUIRED)))
    time = F.try_to_timestamp(F.trim(field["event_time"]))
    version = F.when(absent("schema_version") | (field["schema_version"].isin("0", "false")), F.lit(1).cast("long")).otherwise(whole("schema_version"))
    product = F.when(absent("product_id"), F.lit(0).cast("long")).otherwise(whole("product_id"))
    user = whole("user_id")
    bad = user.isNull() | time.isNull() | version.isNull() | product.isNull()
    error = F.coalesce(
        F.when(F.col("value").isNull() | (F.length("value") == 0), "empty payload"),
        F.when(F.col("text").isNull(), "not valid utf-8"),
        F.when(F.col("payload").isNull(), "invalid json"),
        F.when(~is_object, F.concat(F.lit("payload is "), F.lower(F.regexp_extract(kind, r"^\w+", 0)), F.lit(", expected an object"))),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing required field(s): "), F.concat_ws(",", missing))),
        F.when(bad, "bad field value"),
    )
    optional = lambda c: F.nullif(field[c], F.lit(""))
    seen = F.col("timestamp")
    made = (
        "topic", "partition", "offset", seen.alias("consumed_at"), F.col("value"), error.alias("error"),
        field["event_id"].alias("event_id"), version.cast("int").alias("schema_version"), F.lower(F.trim(field["event_type"])).alias("event_type"),
        user.alias("user_id"), field["session_id"].alias("session_id"), product.alias("product_id"), time.alias("event_time"),
        F.trim(F.coalesce(field["city"], F.lit(""))).alias("city"), optional("device").alias("device"), optional("device_type").alias("device_type"), optional("platform_version").alias("platform_version"),
    )
    # A generated column, so that filters on ``error`` stay above it: below, each of its fields would parse the text anew.
    return rows.select(F.inline(F.array(F.struct(*made))))


EVENT_COLUMNS = ("event_id", "schema_version", "event_type", "user_id", "session_id", "product_id", "event_time", "city", "device", "device_type", "platform_version", "consumed_at")


def events(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NULL").select(*EVENT_COLUMNS)


def dead_letters(parsed: DataFrame) -> DataFrame:
    raw = F.make_valid_utf8(F.col("value").cast("string"))
    return parsed.where("error IS NOT NULL").select("topic", "partition", "offset", "consumed_at", "error", F.coalesce(raw, F.lit("")).alias("raw_value"))


class TooManyMalformed(Exception):
    """A batch has more dead letters than its source is trusted with."""


def ingest(
    spark: SparkSession, source: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, on_batch: Callable[[int, int, int], None] | None = None, most_malformed: int | None = None,
) -> StreamingQuery:
    """Write a stream's events and dead letters, each batch to folders named by its number.

    A batch that is run again after a failure overwrites its own folders, so nothing is lost or doubled. A batch is
    read and parsed once, for its counts, its events and its dead letters. ``trigger`` as for
    writeStream (``processingTime`` or ``availableNow``); ``on_batch`` gets each batch's number, events and dead
    letters. A batch of more than ``most_malformed`` dead letters writes those and ends the stream.
    """

    def put(rows: DataFrame, name: str, number: int, most: int) -> None:
        placed = rows.withColumns({"dt": F.date_format("consumed_at", "yyyy-MM-dd"), "hr": F.date_format("consumed_at", "HH"), "batch": F.lit(number)})
        # An hour's rows go to few files, not to one of every task. Files of many hours take time however small they are, so all cores
        # write them (a rebalanced batch of few bytes is one task); large hours are cut.
        dealt = placed.repartition(spark.sparkContext.defaultParallelism, "dt", "hr") if most <= ROWS_OF_HOUR else placed.hint("rebalance", "dt", "hr")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "hr", "batch").parquet(f"{out}/{name}")

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_events(batch).persist()
        try:
            of_hour = parsed.groupBy(F.date_trunc("hour", "consumed_at")).agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad"))
            good, bad, most_good, most_bad = of_hour.agg(*(F.coalesce(f(c), F.lit(0)) for f in (F.sum, F.max) for c in ("good", "bad"))).collect()[0]
            put(events(parsed), "events", number, most_good)
            if bad:
                put(dead_letters(parsed), "dead_letters", number, most_bad)
        finally:
            parsed.unpersist()
        if on_batch:
            on_batch(number, good, bad)
        if most_malformed is not None and bad > most_malformed:
            raise TooManyMalformed(f"{bad} malformed messages in batch {number}, {most_malformed} are allowed")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
