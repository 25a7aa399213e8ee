"""Named queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from souk.functions import traffic_multiplier
from souk.functions.columns import HOUR_WEIGHTS
from souk.session import scratch
from souk.operators import checks, clean, declared, materialise, reconcile
from souk.operators.versions import as_of, latest_version, since, upsert
from souk.plans import models, operations, quality, staging
from souk.plans.dashboards import CARDS
from souk.plans.oracles import model, sql
from souk.sources import lake
from souk.sources import marketplace as raw
from souk.streaming import live
from souk.streaming.ingest import parse_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _plain(rows: DataFrame) -> DataFrame:
    """Decimals as DOUBLE, so that results of different engines compare."""
    return rows.select(*(F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`") for f in rows.schema))


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: _plain(query(spark, folder))
    if oracle:
        ORACLES[name] = oracle


# Staging models, dimensions, facts, marts.
_MONEY = {"stg_sellers": ["rating"], "dim_sellers": ["rating"], "stg_products": ["price", "cost"], "dim_products": ["price", "cost"], "stg_orders": ["total_amount"], "fct_orders": ["total_amount"], "stg_order_items": ["unit_price", "line_amount"], "fct_order_items": ["unit_price", "line_amount"], "stg_payments": ["amount"], "fct_payments": ["amount"], "mart_daily_gmv": ["gmv"], "mart_seller_performance": ["rating", "revenue"]}
for _name in ("stg_users", "stg_sellers", "stg_categories", "stg_products", "stg_orders", "stg_order_items", "stg_payments", "stg_events"):
    add(_name, getattr(staging, _name), model(_name, *_MONEY.get(_name, [])))
for _name in ("dim_users", "dim_products", "dim_sellers", "dim_categories", "dim_date", "fct_orders", "fct_order_items", "fct_payments", "fct_events", "mart_daily_gmv", "mart_cohort_retention", "mart_seller_performance", "mart_funnel_daily", "mart_funnel_steps"):
    add(_name, getattr(models, _name), model(_name, *_MONEY.get(_name, [])))

# Dashboards.
_REVENUE = "order_status IN ('paid', 'shipped', 'delivered')"
_CARD_SQL = {
    1: "SELECT sum(gmv)::DOUBLE AS total_gmv FROM mart_daily_gmv",
    2: "SELECT sum(orders)::BIGINT AS total_orders FROM mart_daily_gmv",
    3: "SELECT ((sum(gmv) * 100)::BIGINT * 2 + sum(orders)::BIGINT) // (sum(orders)::BIGINT * 2) / 100.0::DOUBLE AS aov FROM mart_daily_gmv",
    4: f"SELECT count(DISTINCT user_id) AS buyers FROM fct_orders WHERE {_REVENUE}",
    5: "SELECT date_key, gmv::DOUBLE AS gmv FROM mart_daily_gmv",
    6: "SELECT date_key, orders, buyers FROM mart_daily_gmv",
    7: f"SELECT c.category_name AS category, sum(f.line_amount)::DOUBLE AS revenue FROM fct_order_items f JOIN dim_categories c ON f.category_id = c.category_id WHERE {_REVENUE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    8: "SELECT seller_name, orders, units_sold, revenue::DOUBLE AS revenue FROM mart_seller_performance ORDER BY mart_seller_performance.revenue DESC, seller_id LIMIT 10",
    9: "SELECT payment_method, sum(amount)::DOUBLE AS revenue, count(*) AS payments FROM fct_payments WHERE payment_status IN ('captured', 'refunded') GROUP BY 1",
    10: "SELECT month_number, cohort_month, retention_rate FROM mart_cohort_retention",
    11: "SELECT cohort_month, month_number, active_users, retention_rate FROM mart_cohort_retention",
    12: "SELECT cohort_month, cohort_size FROM mart_cohort_retention WHERE month_number = 0",
    13: f"SELECT (count(*) FILTER (orders > 1) * 20000 + count(*)) // (count(*) * 2) / 10000.0::DOUBLE AS repeat_rate FROM (SELECT user_id, count(*) AS orders FROM fct_orders WHERE {_REVENUE} GROUP BY 1)",
    14: f"SELECT shipping_city, sum(total_amount)::DOUBLE AS revenue, count(*) AS orders FROM fct_orders WHERE {_REVENUE} GROUP BY 1",
    15: "SELECT step, sessions FROM mart_funnel_steps",
    16: "SELECT step, sessions, share_of_entry, step_conversion_rate FROM mart_funnel_steps",
    17: "SELECT event_date, view_to_cart_rate, cart_to_checkout_rate, checkout_to_purchase_rate FROM mart_funnel_daily",
    18: "SELECT date_trunc('minute', event_time)::TIMESTAMP AS minute, count(*) AS orders FROM live WHERE event_type = 'purchase' GROUP BY 1 HAVING minute >= TIMESTAMP '2024-01-15 11:30:00'",
    19: "SELECT date_trunc('minute', event_time)::TIMESTAMP AS minute, event_type, count(*) AS events FROM live GROUP BY 1, 2 HAVING minute >= TIMESTAMP '2024-01-15 11:30:00'",
    20: "SELECT step, sessions FROM steps",
    21: "SELECT count(DISTINCT session_id) AS sessions FROM live WHERE event_time >= TIMESTAMP '2024-01-15 11:45:00'",
    22: "SELECT count(*) FILTER (status <> 'ok') AS failing FROM health",
    23: "SELECT count(*) FILTER (difference <> 0) AS mismatches FROM row_counts",
    24: "SELECT metric_value AS malformed_last_24h FROM health WHERE metric = 'malformed_last_24h'",
    25: "SELECT entity, metric_value AS hours_since_last_run FROM health WHERE component = 'extract' AND metric = 'last_run_age_hours'",
    26: "SELECT entity, grain, count(*) AS checks, count(*) FILTER (difference <> 0) AS mismatched, sum(abs(difference))::BIGINT AS total_abs_difference FROM row_counts GROUP BY 1, 2",
    27: "SELECT component, entity, metric, metric_value, status FROM health",
    28: "SELECT entity, grain, check_date, source_count, warehouse_count, difference, status FROM row_counts WHERE difference <> 0",
}
for _name, _card in CARDS.items():
    add(_name, _card, sql(_CARD_SQL[int(_name[5:7])]))


# Versions, histories, incremental loads.
def _latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw.raw_events(spark, folder)
    return latest_version(rows, ["event_id"], "consumed_at").select("event_id", "consumed_at", F.trim("city").alias("city"))


add("latest_version", _latest, sql("SELECT event_id, consumed_at, city FROM stg_events"))
add("clean_frame", lambda s, d: clean.clean_frame(raw.raw_events(s, d)), sql("SELECT event_id, schema_version, event_type, user_id, session_id, product_id, event_time, city, device_type, platform_version, consumed_at FROM stg_events"))
add("event_partitions", lambda s, d: clean.with_partitions(clean.clean_frame(raw.raw_events(s, d))).groupBy("dt", "hr").agg(F.count(F.lit(1)).alias("n")), sql("SELECT strftime(event_time, '%Y-%m-%d') AS dt, strftime(event_time, '%H') AS hr, count(*) AS n FROM stg_events GROUP BY ALL"))
add("scd2_users", lambda s, d: models.history(s, d, raw.users, staging.users_of, "user_id").select("user_id", "city", "valid_from", "valid_to"), sql("SELECT user_id, city, valid_from, valid_to FROM user_versions"))
add("scd2_products", lambda s, d: models.history(s, d, raw.products, staging.products_of, "product_id").select("product_id", "price", "valid_from", "valid_to"), sql("SELECT product_id, price::DOUBLE AS price, valid_from, valid_to FROM product_versions"))


def _asof_price(spark: SparkSession, folder: str) -> DataFrame:
    """What a product cost when its line was ordered."""
    lines = staging.stg_order_items(spark, folder).select("order_item_id", "product_id", "created_at")
    return as_of(lines, models.dim_products(spark, folder), "product_id", "created_at", {"price": "price_then"}).select("order_item_id", "price_then")


add("asof_scd2", _asof_price, sql("SELECT order_item_id, coalesce(h.price, c.price)::DOUBLE AS price_then FROM stg_order_items i LEFT JOIN dim_products h ON i.product_id = h.product_id AND i.created_at >= h.valid_from AND (h.valid_to IS NULL OR i.created_at < h.valid_to) LEFT JOIN dim_products c ON i.product_id = c.product_id AND c.is_current"))


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Orders loaded up to 2000, then what is newer, from a day before the newest loaded on."""
    orders = staging.stg_orders(spark, folder)
    loaded = orders.where("updated_at < '2000-01-01'").withColumn("order_status", F.lit("stale"))
    delta = since(orders, loaded, "updated_at", F.expr("INTERVAL 1 DAY"))
    return upsert(loaded, delta, "order_id").select("order_id", "order_status", "updated_at")


add("incremental_upsert", _incremental, sql("SELECT order_id, CASE WHEN updated_at > (SELECT max(updated_at) - INTERVAL 1 DAY FROM stg_orders WHERE updated_at < TIMESTAMP '2000-01-01') THEN order_status ELSE 'stale' END AS order_status, updated_at FROM stg_orders"))


def _incremental_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events loaded up to an instant, then what is newer than the newest loaded less three hours."""
    events = models.fct_events(spark, folder)
    loaded = events.where("event_time < '2024-01-20 12:00:00'").withColumn("city", F.lit("stale"))
    return upsert(loaded, since(events, loaded, "event_time", F.expr("INTERVAL 3 HOURS")), "event_id").select("event_id", "city", "event_time")


add("incremental_events", _incremental_events, sql("SELECT event_id, CASE WHEN event_time > (SELECT max(event_time) - INTERVAL 3 HOUR FROM fct_events WHERE event_time < TIMESTAMP '2024-01-20 12:00:00') THEN city ELSE 'stale' END AS city, event_time FROM fct_events"))
add("window_extract", lambda s, d: lake.extract_window(raw.orders(s, d), "updated_at", datetime(1998, 1, 1), datetime(1998, 2, 1)).select("order_id", "updated_at"), sql("SELECT order_id, updated_at FROM stg_orders WHERE updated_at > TIMESTAMP '1998-01-01' AND updated_at <= TIMESTAMP '1998-02-01'"))
add("window_clean", lambda s, d: clean.clean_frame(raw.raw_events(s, d).where(F.col("event_time") >= F.lit(clean.window_start(datetime(2024, 1, 15, 11, 47, 13), 3)))).select("event_id", "event_time"), sql("SELECT event_id, event_time FROM stg_events WHERE event_time >= TIMESTAMP '2024-01-15 08:00:00'"))


# Data quality.
add("dq_unique", lambda s, d: checks.not_unique(raw.read(s, d, "lineitem"), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
add("dq_not_null", lambda s, d: checks.is_null(models.fct_orders(s, d), "user_sk").select("order_id", "user_id"), sql("SELECT order_id, user_id FROM fct_orders WHERE user_sk IS NULL"))
add("dq_accepted_values", lambda s, d: checks.not_accepted(raw.read(s, d, "events"), "event_type", tuple(raw.EVENT_TYPES)), "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'signup', 'purchase') GROUP BY ALL")
add("dq_relationships", lambda s, d: checks.orphans(raw.read(s, d, "orders"), "o_orderkey", raw.read(s, d, "lineitem"), "l_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
add(
    "dq_report",
    lambda s, d: checks.column_report(models.fct_orders(s, d), unique=("order_id",), present=("order_id", "user_id", "user_sk"), accepted={"order_status": raw.REVENUE}),
    sql(f"SELECT 'not_null' AS \"check\", 'order_id' AS \"column\", count(*) FILTER (order_id IS NULL) AS failures FROM fct_orders UNION ALL SELECT 'not_null', 'user_id', count(*) FILTER (user_id IS NULL) FROM fct_orders UNION ALL SELECT 'not_null', 'user_sk', count(*) FILTER (user_sk IS NULL) FROM fct_orders UNION ALL SELECT 'accepted', 'order_status', count(*) FILTER (NOT {_REVENUE}) FROM fct_orders UNION ALL SELECT 'unique', 'order_id', (SELECT count(*) FROM (SELECT order_id FROM fct_orders GROUP BY 1 HAVING count(*) > 1))"),
)
add("dq_cohort_grain", lambda s, d: checks.not_unique(models.mart_cohort_retention(s, d), "cohort_month", "month_number"), sql("SELECT cohort_month, month_number, count(*) AS n FROM mart_cohort_retention GROUP BY 1, 2 HAVING count(*) > 1"))
add("dq_cohort_bounds", lambda s, d: checks.cohort_bounds(models.mart_cohort_retention(s, d)), sql("SELECT cohort_month, cohort_size, month_number, active_users, retention_rate FROM mart_cohort_retention WHERE retention_rate < 0 OR retention_rate > 1.0001 OR (month_number = 0 AND retention_rate <> 1) OR active_users > cohort_size"))
add("dq_revenue_reconcile", lambda s, d: checks.revenue_differs(models.revenue_orders(models.fct_orders(s, d)), models.revenue_orders(models.fct_order_items(s, d))), sql(f"SELECT a::DOUBLE AS orders_revenue, b::DOUBLE AS items_revenue FROM (SELECT sum(total_amount) AS a FROM fct_orders WHERE {_REVENUE}), (SELECT sum(line_amount) AS b FROM fct_order_items WHERE {_REVENUE}) WHERE abs(a - b) > 0.01"))
add("dq_order_total", lambda s, d: checks.totals_differ(models.fct_orders(s, d), models.fct_order_items(s, d)), sql("SELECT order_id, total_amount::DOUBLE AS total_amount, t::DOUBLE AS items_total FROM fct_orders JOIN (SELECT order_id, sum(line_amount) AS t FROM fct_order_items GROUP BY 1) USING (order_id) WHERE abs(total_amount - t) > 0.01"))
add("dq_funnel_monotonic", lambda s, d: checks.funnel_widens(models.mart_funnel_steps(s, d)), sql("SELECT c.step_order, c.sessions, p.sessions AS previous_sessions FROM steps c JOIN steps p ON p.step_order = c.step_order - 1 WHERE c.sessions > p.sessions"))
add("dq_funnel_bounds", lambda s, d: checks.funnel_out_of_bounds(models.mart_funnel_daily(s, d)), sql("SELECT * EXCLUDE (sessions) FROM mart_funnel_daily WHERE view_to_cart_rate NOT BETWEEN 0 AND 1 OR cart_to_checkout_rate NOT BETWEEN 0 AND 1 OR checkout_to_purchase_rate NOT BETWEEN 0 AND 1 OR view_to_purchase_rate NOT BETWEEN 0 AND 1 OR cart_sessions > page_view_sessions OR checkout_sessions > cart_sessions OR purchase_sessions > checkout_sessions"))
add("dq_one_current_user", lambda s, d: checks.many_current(models.dim_users(s, d), "user_id"), sql("SELECT user_id, count(*) AS n FROM dim_users WHERE is_current GROUP BY 1 HAVING count(*) > 1"))
add("dq_one_current_product", lambda s, d: checks.many_current(models.dim_products(s, d), "product_id"), sql("SELECT product_id, count(*) AS n FROM dim_products WHERE is_current GROUP BY 1 HAVING count(*) > 1"))
add("dq_freshness", lambda s, d: checks.freshness(raw.raw_events(s, d), "consumed_at", reconcile.NOW, 3.0, 12.0), sql("SELECT round(date_diff('microsecond', max(consumed_at), TIMESTAMP '2024-01-31') / 3600000000.0, 2)::DOUBLE AS age_hours, CASE WHEN age_hours >= 12 THEN 'error' WHEN age_hours >= 3 THEN 'warn' ELSE 'ok' END AS status FROM stg_events"))
add("dq_row_counts", lambda s, d: reconcile.row_counts(s, d), sql("SELECT * FROM row_counts"))
add("dq_health", lambda s, d: operations.stored(s, d, "health"), sql("SELECT * FROM health"))


def _series(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by day against events by day: no day in common, a NULL key on one side."""
    source = raw.orders(spark, folder).groupBy(F.to_date("created_at").alias("check_date")).agg(F.count(F.lit(1)).alias("n"))
    other = raw.read(spark, folder, "events").groupBy(F.when(F.col("event_type") != "error", F.to_date("ts")).alias("check_date")).agg(F.count(F.lit(1)).alias("n"))
    return reconcile.compare_series(source, other, "mixed", "day").orderBy(F.asc_nulls_last("check_date"))


add("full_outer_series", _series, "WITH s AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT CASE WHEN event_type <> 'error' THEN ts::DATE END AS d, count(*) AS n FROM events GROUP BY 1) SELECT 'mixed' AS entity, 'day' AS grain, coalesce(s.d, w.d) AS check_date, coalesce(s.n, 0) AS source_count, coalesce(w.n, 0) AS warehouse_count, coalesce(s.n, 0) - coalesce(w.n, 0) AS difference, CASE WHEN coalesce(s.n, 0) = coalesce(w.n, 0) THEN 'ok' ELSE 'mismatch' END AS status FROM s FULL JOIN w ON s.d IS NOT DISTINCT FROM w.d")


# Streaming, as far as a batch gives the answer of a finished stream.
_ERRORS = "CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'empty payload' WHEN 1 THEN 'not valid utf-8' WHEN 2 THEN 'invalid json' WHEN 3 THEN 'payload is array, expected an object' ELSE 'missing required field(s): event_type,session_id,event_time' END END"
add("parse_dlq", lambda s, d: parse_events(raw.messages(s, d)).select("offset", "error", "event_type", "user_id", "event_time"), f"SELECT event_id AS \"offset\", {_ERRORS} AS error, CASE WHEN event_type <> 'error' THEN event_type END AS event_type, CASE WHEN event_type <> 'error' THEN user_id WHEN event_id % 5 = 4 THEN 5 END::BIGINT AS user_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts)::TIMESTAMP END AS event_time FROM events")
add("live_dedup", lambda s, d: live.live_events(raw.sent_events(s, d)).select("event_id", "event_type", "ingested_at"), sql("SELECT event_id, event_type, consumed_at AS ingested_at FROM live"))
add("per_minute_events", lambda s, d: live.events_per_minute(live.live_events(raw.sent_events(s, d))), sql("SELECT date_trunc('minute', event_time)::TIMESTAMP AS minute, event_type, count(*) AS events FROM live GROUP BY 1, 2"))
add("per_minute_orders", lambda s, d: live.orders_per_minute(live.live_events(raw.sent_events(s, d))), sql("SELECT date_trunc('minute', event_time)::TIMESTAMP AS minute, count(*) AS orders FROM live WHERE event_type = 'purchase' GROUP BY 1"))

# How models and snapshots are kept.
def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    store = reconcile.Snapshots(spark, scratch(spark, "snapshots"))
    store.store(reconcile.row_counts(spark, folder))
    return store.newest()


add("mat_view", lambda s, d: materialise.view(models.mart_daily_gmv(s, d), "kept_daily_gmv"), sql("SELECT * FROM mart_daily_gmv"))
add("mat_table", lambda s, d: materialise.table(models.mart_funnel_daily(s, d), scratch(s, "funnel"), ("event_date",)), sql("SELECT * FROM mart_funnel_daily"))
add("dq_snapshot", _snapshot, sql("SELECT * FROM row_counts"))

# The pipeline in operation: topics, bounded runs, their log, a view kept by a stream, counts up to a watermark.
_BROKEN = _ERRORS
add(
    "offset_range_read",
    operations.offset_range_read,
    """SELECT partition, "offset", key, timestamp, n_bytes FROM (
      SELECT user_id % 6 AS partition, row_number() OVER (PARTITION BY user_id % 6 ORDER BY event_id) - 1 AS "offset", count(*) OVER (PARTITION BY user_id % 6) AS n, user_id::VARCHAR AS key, ts::TIMESTAMP AS timestamp,
        CASE WHEN event_type <> 'error' THEN length(to_json({event_id: 'evt-' || event_id, schema_version: 1, event_type: event_type, user_id: user_id, session_id: 's', event_time: strftime(ts, '%Y-%m-%dT%H:%M:%SZ')}))
          ELSE CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 15 WHEN 3 THEN 6 ELSE 31 END END AS n_bytes
      FROM events) WHERE "offset" >= n // 4 AND "offset" < n - n // 4""",
)
add(
    "ingest_bounded",
    operations.ingest_bounded,
    f"""SELECT least((row_number() OVER (ORDER BY event_id) - 1) // (SELECT count(*) // 3 FROM events), 2)::INTEGER AS run, CASE WHEN event_type = 'error' THEN 'dead_letters' ELSE 'events' END AS kind,
      {_BROKEN} AS error, ts::TIMESTAMP AS consumed_at FROM events""",
)
add(
    "run_log",
    operations.run_log,
    sql("""SELECT 'extract' AS component, NULL AS run_id, t AS entity, 'ok' AS status, 'rows' AS metric, n::DOUBLE AS value FROM (
      SELECT 'categories' AS t, count(*) AS n FROM stg_categories UNION ALL SELECT 'order_items', count(*) FROM stg_order_items UNION ALL SELECT 'orders', count(*) FROM stg_orders UNION ALL SELECT 'payments', count(*) FROM stg_payments
      UNION ALL SELECT 'products', (SELECT count(*) FROM part) UNION ALL SELECT 'sellers', count(*) FROM stg_sellers UNION ALL SELECT 'users', (SELECT count(*) FROM customer))
    UNION ALL SELECT 'stream', 'stream-' || i, 'events', 'ok', m, CASE m WHEN 'records' THEN count(*) ELSE count(*) FILTER (event_type = 'error') END FROM (
      SELECT CASE WHEN ts::DATE = (SELECT max(ts)::DATE FROM events) THEN 1 ELSE 0 END AS i, event_type FROM events), (VALUES ('records'), ('malformed')) v(m) GROUP BY i, m
    UNION ALL SELECT 'clean', 'clean-0', '', 'ok', m, CASE m WHEN 'input_rows' THEN cleaned WHEN 'output_rows' THEN cleaned - duplicates ELSE duplicates END FROM runs, (VALUES ('input_rows'), ('output_rows'), ('duplicates_removed')) v(m)
      WHERE started_at = (SELECT max(started_at) FROM runs)"""),
)
add("mat_mv_minutes", operations.mat_mv_minutes, sql("SELECT date_trunc('minute', event_time)::TIMESTAMP AS minute, event_type, count(*) AS events FROM live GROUP BY 1, 2"))
add(
    "dq_reconcile_bounded",
    operations.reconcile_bounded,
    """SELECT e.entity, 'day' AS grain, o_orderdate::DATE AS check_date, count(*) AS source_count, count(*) AS warehouse_count, 0::BIGINT AS difference, 'ok' AS status
      FROM orders, (VALUES ('orders'), ('payments')) e(entity) WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY ALL""",
)

add("clean_run", operations.clean_run, sql("SELECT event_id, city, strftime(event_time, '%Y-%m-%d') AS dt, hour(event_time)::INTEGER AS hr FROM stg_events WHERE event_time::DATE = (SELECT max(event_time)::DATE FROM stg_events)"))
add(
    "extract_run",
    operations.extract_run,
    sql("""SELECT entity, n_rows, first_key::BIGINT AS first_key, last_key::BIGINT AS last_key, newest_at AS watermark FROM newest JOIN (
      SELECT 'categories' AS entity, count(*) AS n_rows, min(category_id) AS first_key, max(category_id) AS last_key FROM stg_categories UNION ALL SELECT 'order_items', count(*), min(order_item_id), max(order_item_id) FROM stg_order_items
      UNION ALL SELECT 'orders', count(*), min(order_id), max(order_id) FROM stg_orders UNION ALL SELECT 'payments', count(*), min(payment_id), max(payment_id) FROM stg_payments
      UNION ALL SELECT 'products', count(*), min(p_partkey), max(p_partkey) FROM part UNION ALL SELECT 'sellers', count(*), min(seller_id), max(seller_id) FROM stg_sellers UNION ALL SELECT 'users', count(*), min(c_custkey), max(c_custkey) FROM customer) ON entity = t"""),
)
add(
    "ingest_dead_letters",
    operations.dead_letters,
    f"""SELECT (user_id % 6)::INTEGER AS partition, ts::TIMESTAMP AS consumed_at, {_ERRORS} AS error,
      CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN chr(65533) || chr(65533) || chr(0) WHEN 2 THEN '{{"event_id": "x' WHEN 3 THEN '[1, 2]' ELSE '{{"event_id": "x", "user_id": 5}}' END AS raw_value FROM events WHERE event_type = 'error'""",
)
add(
    "load_contract",
    operations.load_contract,
    sql("""SELECT order_id::BIGINT AS order_id, CASE WHEN order_id % 4 = 2 AND order_id % 5 = 0 THEN NULL ELSE user_id END::BIGINT AS user_id, CASE WHEN order_id % 4 <> 1 THEN lower(currency) END AS currency, total_amount::DOUBLE AS total_amount,
      CASE WHEN order_id % 4 = 2 AND order_id % 5 = 0 THEN 'user_id is missing' WHEN order_id % 4 = 2 AND order_id % 7 = 0 THEN 'total_amount is no decimal(14,2)' END AS reason FROM stg_orders WHERE order_id % 4 <> 3"""),
)

add("catalog_keys", operations.catalog_keys, sql("SELECT 'orders' AS entity, 'order_id' AS key, order_id::BIGINT AS id, total_amount::DOUBLE AS amount FROM stg_orders UNION ALL SELECT 'payments', 'updated_at', payment_id, amount::DOUBLE FROM stg_payments"))

# Declared tests, freshness of sources, differences of keys, histories from logs of changes.
def _declared_sql(test: declared.DataTest) -> str:
    column, model = test.column, test.model
    failures = {
        "not_null": f"SELECT count(*) FROM {model} WHERE {column} IS NULL",
        "unique": f"SELECT count(*) FROM (SELECT {column} FROM {model} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
        "accepted_values": f"SELECT count(*) FROM {model} WHERE {column} NOT IN ({', '.join(map(repr, test.values))})",
        "relationships": f"SELECT count(*) FROM {model} m WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {test.to and test.to[0]} t WHERE t.{test.to and test.to[1]} = m.{column})",
    }[test.kind]
    return f"SELECT '{model}' AS model, '{column}' AS \"column\", '{test.kind}' AS test, ({failures}) AS failures"


add("dq_declared", quality.dq_declared, sql("\nUNION ALL ".join(map(_declared_sql, quality.TESTS))))


def _age_sql(source: str, rows: str, column: str, warn: float, error: float) -> str:
    age = f"coalesce(round(date_diff('microsecond', max({column}), TIMESTAMP '1998-08-04') / 3600000000.0, 2), 'inf'::DOUBLE)"
    return f"SELECT '{source}' AS source, max({column})::TIMESTAMP AS newest, {age} AS age_hours, CASE WHEN {age} >= {error} THEN 'error' WHEN {age} >= {warn} THEN 'warn' ELSE 'ok' END AS status FROM {rows}"


_AS_LOADED = "(SELECT TIMESTAMP '1995-01-01' AS updated_at FROM {})"
_DATED = {"users": _AS_LOADED.format("customer"), "products": _AS_LOADED.format("part")}
add("dq_source_freshness", quality.dq_source_freshness, sql(" UNION ALL ".join(_age_sql(t, _DATED.get(t, f"stg_{t}"), *limits) for t, limits in quality.FRESHNESS.items())))
_LOST = "o_orderkey % 997 = 5 AND o_orderkey % 2 = 0"
add(
    "key_difference",
    quality.order_key_difference,
    f"""WITH w AS (SELECT o_orderkey AS key FROM orders WHERE NOT ({_LOST}) UNION ALL SELECT o_orderkey FROM orders, range(2) WHERE NOT ({_LOST}) AND o_orderkey % 1999 = 7 UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 2999 = 1),
      a AS (SELECT key, sum(s)::BIGINT AS source_count, sum(1 - s)::BIGINT AS warehouse_count FROM (SELECT o_orderkey AS key, 1 AS s FROM orders UNION ALL SELECT key, 0 FROM w) GROUP BY 1)
      SELECT * FROM a WHERE source_count <> warehouse_count""",
)
add(
    "scd2_from_changelog",
    quality.scd2_from_changelog,
    """WITH told AS (SELECT user_id, ts, event_type = 'error' AS removed, CASE WHEN event_type <> 'error' THEN event_type END AS state, CASE WHEN event_type <> 'error' THEN value >= 50 END AS large
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1),
      starts AS (SELECT * FROM told WINDOW w AS (PARTITION BY user_id ORDER BY ts) QUALIFY lag(ts) OVER w IS NULL OR lag(removed) OVER w IS DISTINCT FROM removed OR lag(state) OVER w IS DISTINCT FROM state OR lag(large) OVER w IS DISTINCT FROM large),
      closed AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM starts)
      SELECT user_id, state, large, ts::TIMESTAMP AS valid_from, valid_to::TIMESTAMP AS valid_to FROM closed WHERE NOT removed""",
)

# Simulation.
_WEIGHTS = list(HOUR_WEIGHTS)
add("traffic_multiplier", lambda s, d: raw.read(s, d, "events").select("event_id", traffic_multiplier(F.col("ts").cast("timestamp") + F.expr("INTERVAL 240 DAYS") + F.make_interval(days=(F.col("event_id") % 90).cast("int"))).alias("multiplier")), f"SELECT event_id, ({_WEIGHTS}::DOUBLE[])[hour(l) + 1] * CASE WHEN strftime(l, '%m-%d') IN ('09-09', '11-11', '12-12') THEN 5.0 ELSE 1.0 END AS multiplier FROM (SELECT event_id, ts + INTERVAL 240 DAY + to_days((event_id % 90)::INTEGER) + INTERVAL 7 HOUR AS l FROM events)")
