"""Simulated orders, their changes and a clickstream, as columns of row numbers.

Every random choice is a hash of (row, seed, purpose): a rerun gives the same rows, in any partitioning, and
a range of rows can be made again alone. Rates and weights are parameters with the marketplace's values.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.columns import CAMPAIGN_DAYS, LOCAL_ZONE, traffic_multiplier
from souk.sources.marketplace import FUNNEL, SCHEMA_2_FROM

# Status changes and their chances, the event mix, rates of flaws in the stream.
TRANSITIONS = {"pending": (("paid", 0.85), ("cancelled", 0.15)), "paid": (("shipped", 0.92), ("refunded", 0.08)), "shipped": (("delivered", 0.97), ("refunded", 0.03))}
EVENT_MIX = tuple(zip(FUNNEL, (0.70, 0.18, 0.07, 0.05), strict=True))
DUPLICATES, LATE, MALFORMED, NEW_SESSION = 0.02, 0.03, 0.005, 0.3
LATEST_SECONDS = 7200
CITIES = ("Jakarta", "Bandung", "Surabaya", "Medan")
DEVICES = ("android", "ios", "web")


def uniform(seed: int, purpose: str, *keys: Column) -> Column:
    """A number in [0, 1) for each row."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(f"{seed}:{purpose}")), 11).cast("double") / float(1 << 53)


def pick(u: Column, choices: tuple[tuple[str, float], ...]) -> Column:
    """A weighted choice by a number in [0, 1)."""
    total, found, upto = sum(w for _, w in choices), None, 0.0
    for name, weight in choices[:-1]:
        upto += weight / total
        found = F.when(u < upto, name) if found is None else found.when(u < upto, name)
    return F.lit(choices[-1][0]) if found is None else found.otherwise(choices[-1][0])


def one_of(u: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def poisson(mean: Column, seed: int, purpose: str, *keys: Column) -> Column:
    """A Poisson count: exponential gaps that fit into the mean; from 30 on the normal approximation."""
    gaps = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: -F.log(1 - uniform(seed, purpose, *keys, i)))
    fitted = F.aggregate(gaps, F.struct(F.lit(0.0).alias("at"), F.lit(0).alias("n")), lambda a, g: F.struct((a["at"] + g).alias("at"), (a["n"] + (a["at"] + g <= mean).cast("int")).alias("n")), lambda a: a["n"])
    u, v = uniform(seed, purpose + "u", *keys), uniform(seed, purpose + "v", *keys)
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)
    return F.when(mean <= 30, fitted).otherwise(F.greatest(F.lit(0), F.round(mean + F.sqrt(mean) * normal).cast("int")))


def hours(spark: SparkSession, start: datetime, n: int, per_hour: float, seed: int = 0) -> DataFrame:
    """(hour, expected, n) of a stretch of hours with the traffic curve's counts."""
    rows = spark.range(n).select((F.lit(start) + F.make_interval(hours=F.col("id").cast("int"))).alias("hour"))
    rows = rows.withColumn("expected", traffic_multiplier(F.col("hour")) * per_hour)
    return rows.withColumn("n", poisson(F.col("expected"), seed, "hour", F.col("hour")))


def instants(counts: DataFrame, seed: int = 0) -> DataFrame:
    """A row for each of the hours' counts, at an even chance within its hour."""
    rows = counts.where("n > 0").select("hour", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return rows.select("hour", "k", F.timestamp_seconds(F.unix_timestamp("hour") + F.floor(uniform(seed, "second", F.col("hour"), F.col("k")) * 3600)).alias("at"))


def orders(spark: SparkSession, n: int, n_users: int, products: DataFrame, start: datetime, days: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(orders, items): 1 to 4 lines of 1 to 3 pieces; campaign days cost 10-30 % less, else three in ten lines 5-15 %.

    ``products`` (product_id, price) have ids from 0 without gaps. Three orders in four are paid at once.
    """
    ident = F.col("order_id")
    n_products = products.count()
    made = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.floor(uniform(seed, "when", ident) * days * 86400))
    paid = uniform(seed, "paid", ident) < 0.75
    base = spark.range(n).select((F.col("id") + 1).alias("order_id")).select("order_id", F.floor(uniform(seed, "user", ident) * n_users).alias("user_id"), F.when(paid, "paid").otherwise("pending").alias("status"), one_of(uniform(seed, "city", ident), CITIES).alias("shipping_city"), made.alias("created_at"))
    line = F.col("line")
    draw = lambda what: uniform(seed, what, ident, line)
    lines = base.select("order_id", "created_at", F.explode(F.sequence(F.lit(1), (F.floor(uniform(seed, "lines", ident) * 4) + 1).cast("int"))).alias("line"))
    lines = lines.withColumn("product_id", F.pmod(F.floor(uniform(seed, "product", ident) * n_products) + line * 7919, F.lit(n_products)))
    campaign = F.date_format(F.from_utc_timestamp("created_at", LOCAL_ZONE), "MM-dd").isin(*CAMPAIGN_DAYS)
    discount = F.when(campaign, 0.10 + 0.20 * draw("sale")).when(draw("promo") < 0.30, 0.05 + 0.10 * draw("cut")).otherwise(0.0)
    items = lines.join(products.select("product_id", "price"), "product_id").select((ident * 10 + line).alias("order_item_id"), "order_id", "product_id", (F.floor(draw("quantity") * 3) + 1).cast("int").alias("quantity"), F.greatest(F.round(F.col("price") * (1 - discount).cast("decimal(9,6)"), 2), F.lit("0.01").cast("decimal(14,2)")).cast("decimal(14,2)").alias("unit_price"), "created_at")
    totals = items.groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(14,2)").alias("total_amount"))
    return base.join(totals, "order_id"), items


def next_status(status: Column, u: Column) -> Column:
    """The status after one more step; final ones stay."""
    found = None
    for name, options in TRANSITIONS.items():
        found = F.when(status == name, pick(u, options)) if found is None else found.when(status == name, pick(u, options))
    return found.otherwise(status)


def payment_status(order_status: Column, fallback: Column | None = None) -> Column:
    return F.when(order_status == "cancelled", "failed").when(order_status == "refunded", "refunded").when(order_status.isin("paid", "shipped", "delivered"), "captured").otherwise(F.lit("pending") if fallback is None else fallback)


def drift_price(price: Column, u: Column) -> Column:
    """Up to 8 % more or less, in whole cents and one at least."""
    return F.greatest(F.round(price * (0.92 + 0.16 * u).cast("decimal(9,6)"), 2), F.lit("0.01").cast("decimal(14,2)")).cast("decimal(14,2)")


def messages(instants: DataFrame, n_users: int, n_products: int, seed: int = 0) -> DataFrame:
    """(key, value, timestamp, malformed, duplicate): the clickstream's messages from (hour, k, at).

    Some come late, some twice with the same bytes, some cut short, without their ids, or not as JSON at all.
    A user's session is the hour's, unless a new one begins.
    """
    key = [F.col("hour"), F.col("k")]
    u = lambda what: uniform(seed, what, *key)
    user = F.floor(u("user") * n_users)
    late = F.when(u("late") < LATE, F.floor(u("lateness") * LATEST_SECONDS)).otherwise(0)
    rows = instants.withColumns({"user_id": user, "when": F.timestamp_seconds(F.unix_timestamp("at") - late)}).withColumn("new", F.col("when") >= F.lit(SCHEMA_2_FROM))
    device = one_of(u("device"), DEVICES)
    session = F.md5(F.concat_ws("|", "user_id", "hour", F.when(u("session") < NEW_SESSION, F.col("k"))).cast("binary"))
    ident = F.md5(F.concat_ws("|", F.lit(seed), *key).cast("binary"))
    rest = [
        F.when(F.col("new"), 2).otherwise(1).alias("schema_version"), pick(u("type"), EVENT_MIX).alias("event_type"), session.alias("session_id"), F.floor(u("product") * n_products).alias("product_id"),
        F.date_format("when", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"), one_of(u("city"), CITIES).alias("city"),
        F.when(~F.col("new"), device).alias("device"), F.when(F.col("new"), device).alias("device_type"), F.when(F.col("new"), F.concat((F.floor(u("major") * 3) + 2).cast("string"), F.lit("."), F.floor(u("minor") * 10).cast("string"))).alias("platform_version"),
    ]
    whole = F.to_json(F.struct(ident.alias("event_id"), F.col("user_id"), *rest))
    broken = F.when(u("flaw") < 0.4, F.substring(whole, 1, 16)).when(u("flaw") < 0.8, F.to_json(F.struct(*rest))).otherwise('{"event_type": "page_view", "oops": ')
    malformed = u("malformed") < MALFORMED
    copies = F.when(u("twice") < DUPLICATES, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    made = rows.select(F.col("user_id").cast("string").cast("binary").alias("key"), F.when(malformed, broken).otherwise(whole).cast("binary").alias("value"), F.col("at").alias("timestamp"), malformed.alias("malformed"), copies.alias("copies"))
    return made.select("key", "value", "timestamp", "malformed", F.explode("copies").alias("duplicate"))
