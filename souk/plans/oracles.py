"""SQL oracles: every model written once more, for an engine that isn't Spark, over the same tables."""

from __future__ import annotations

_RAW = """
geo AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
user_base AS (SELECT c.*, g.n_name AS city, upper(g.r_name) AS country, g2.n_name AS next_city, upper(g2.r_name) AS next_country
  FROM customer c JOIN geo g ON c_nationkey = g.n_nationkey JOIN geo g2 ON (c_nationkey + 1) % 25 = g2.n_nationkey),
user_versions AS (
  SELECT c_custkey AS user_id, lower(c_name) || '@example.com' AS email, c_name AS full_name,
    CASE WHEN c_custkey % 7 <> 0 THEN '+62-' || c_custkey END AS phone, city, country AS country_code,
    TIMESTAMP '1995-01-01' AS valid_from,
    CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '1998-07-01' WHEN c_custkey % 97 = 0 THEN TIMESTAMP '2000-07-01' END AS valid_to
  FROM user_base
  UNION ALL
  SELECT c_custkey, lower(c_name) || '@example.com', c_name, CASE WHEN c_custkey % 7 <> 0 THEN '+62-' || c_custkey END, next_city, next_country,
    TIMESTAMP '1998-07-01', CASE WHEN c_custkey % 97 = 0 THEN TIMESTAMP '2000-07-01' END
  FROM user_base WHERE c_custkey % 10 = 0),
dim_users AS (SELECT ('0x' || substr(md5(user_id || '|' || strftime(valid_from, '%Y-%m-%d %H:%M:%S')), 1, 15))::BIGINT AS user_sk, *, valid_to IS NULL AS is_current FROM user_versions),
stg_users AS (SELECT user_id, email, full_name, phone, city, country_code, TIMESTAMP '1995-01-01' AS created_at, valid_from AS updated_at
  FROM user_versions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY valid_from DESC) = 1),
stg_sellers AS (SELECT s_suppkey AS seller_id, s_name AS seller_name, lower(s_name) || '@shop.example' AS email, n_name AS city, upper(r_name) AS country_code,
    (3 + (s_suppkey % 201) / 100.0)::DECIMAL(3,2) AS rating, TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at
  FROM supplier JOIN geo ON s_nationkey = n_nationkey),
kinds AS (SELECT p_type, row_number() OVER (ORDER BY p_type)::INTEGER AS category_id FROM (SELECT DISTINCT p_type FROM part)),
stg_categories AS (SELECT category_id, p_type AS category_name, lower(p_type) AS slug, CASE WHEN category_id > 2 THEN (category_id - 1) % 2 + 1 END::INTEGER AS parent_category_id,
  TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at FROM kinds),
part_base AS (SELECT p.*, category_id, p_partkey % (SELECT count(*) FROM supplier) AS seller_id, p_retailprice::DECIMAL(14,2) AS price0,
    (p_retailprice::DECIMAL(14,2) * 1.05::DECIMAL(3,2))::DECIMAL(14,2) AS price1 FROM part p JOIN kinds USING (p_type)),
product_rows AS (
  SELECT *, price0 AS price, TIMESTAMP '1995-01-01' AS valid_from, CASE WHEN p_partkey % 10 = 0 THEN TIMESTAMP '1998-07-01' WHEN p_partkey % 97 = 0 THEN TIMESTAMP '2000-07-01' END AS valid_to FROM part_base
  UNION ALL
  SELECT *, price1, TIMESTAMP '1998-07-01', CASE WHEN p_partkey % 97 = 0 THEN TIMESTAMP '2000-07-01' END FROM part_base WHERE p_partkey % 10 = 0),
product_costs AS (SELECT *, (price * 0.60::DECIMAL(3,2))::DECIMAL(14,2) AS cost FROM product_rows),
product_versions AS (SELECT p_partkey AS product_id, seller_id, category_id, p_name AS product_name, 'SKU-' || p_partkey AS sku, price, cost, p_size AS stock, p_partkey % 20 <> 0 AS is_active,
    (((price - cost) * 100)::BIGINT * 20000 + (price * 100)::BIGINT) // ((price * 100)::BIGINT * 2) / 10000.0::DOUBLE AS gross_margin_ratio, valid_from, valid_to FROM product_costs),
dim_products AS (SELECT ('0x' || substr(md5(product_id || '|' || strftime(valid_from, '%Y-%m-%d %H:%M:%S')), 1, 15))::BIGINT AS product_sk, *, valid_to IS NULL AS is_current FROM product_versions),
stg_products AS (SELECT * EXCLUDE (valid_from, valid_to), TIMESTAMP '1995-01-01' AS created_at, valid_from AS updated_at
  FROM product_versions QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY valid_from DESC) = 1),
dim_sellers AS (SELECT ('0x' || substr(md5(seller_id::VARCHAR), 1, 15))::BIGINT AS seller_sk, seller_id, seller_name, email, city, country_code, rating FROM stg_sellers),
dim_categories AS (SELECT ('0x' || substr(md5(c.category_id::VARCHAR), 1, 15))::BIGINT AS category_sk, c.category_id, c.category_name, c.slug, c.parent_category_id, p.category_name AS parent_category_name
  FROM stg_categories c LEFT JOIN stg_categories p ON c.parent_category_id = p.category_id),
order_states AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN CASE o_orderkey % 10 WHEN 1 THEN 'cancelled' WHEN 0 THEN 'refunded' ELSE 'delivered' END
    WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'shipped' ELSE 'paid' END ELSE 'pending' END AS order_status FROM orders),
stg_orders AS (SELECT o_orderkey AS order_id, o_custkey AS user_id, order_status, 'IDR' AS currency, city AS shipping_city, o_totalprice::DECIMAL(14,2) AS total_amount,
    o_orderdate::DATE AS order_date, o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP AS updated_at, order_status IN ('delivered', 'cancelled', 'refunded') AS is_terminal
  FROM order_states LEFT JOIN user_base ON o_custkey = c_custkey),
stg_order_items AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS order_item_id,
    l_orderkey AS order_id, l_partkey AS product_id, l_quantity::INTEGER AS quantity, p_retailprice::DECIMAL(14,2) AS unit_price, (l_quantity::INTEGER * p_retailprice::DECIMAL(14,2))::DECIMAL(18,2) AS line_amount,
    o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP AS updated_at
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
stg_payments AS (SELECT o_orderkey AS payment_id, o_orderkey AS order_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'bank_transfer' WHEN '3-MEDIUM' THEN 'va' WHEN '4-NOT SPECIFIED' THEN 'ewallet' ELSE 'cod' END AS payment_method,
    o_totalprice::DECIMAL(14,2) AS amount, CASE WHEN order_status = 'cancelled' THEN 'failed' WHEN order_status = 'refunded' THEN 'refunded' WHEN order_status = 'pending' THEN 'pending' ELSE 'captured' END AS payment_status,
    o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP AS updated_at FROM order_states),
stg_events AS (SELECT 'evt-' || event_id AS event_id, (CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 2 ELSE 1 END)::INTEGER AS schema_version,
    CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'checkout' ELSE 'purchase' END AS event_type, user_id,
    user_id || '-' || ts::DATE AS session_id, json_extract_string(props, '$.k')::BIGINT AS product_id, ts::TIMESTAMP AS event_time, ts::DATE AS event_date, date_trunc('hour', ts)::TIMESTAMP AS event_hour,
    CASE WHEN event_id % 50 = 0 THEN 'Bandung' ELSE 'Jakarta' END AS city, CASE event_id % 3 WHEN 0 THEN 'android' WHEN 1 THEN 'ios' ELSE 'web' END AS device_type,
    CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN '3.' || event_id % 5 END AS platform_version,
    (ts + CASE WHEN event_id % 33 = 0 THEN INTERVAL 90 MINUTE ELSE INTERVAL 1 MINUTE END + CASE WHEN event_id % 50 = 0 THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END)::TIMESTAMP AS consumed_at
  FROM events WHERE event_type <> 'error'),
dim_date AS (SELECT d::DATE AS date_key, year(d)::INTEGER AS year, quarter(d)::INTEGER AS quarter, month(d)::INTEGER AS month, monthname(d) AS month_name, day(d)::INTEGER AS day_of_month, isodow(d)::INTEGER AS day_of_week, dayname(d) AS day_name, isodow(d) >= 6 AS is_weekend
  FROM (SELECT unnest(generate_series(min(order_date)::TIMESTAMP, max(order_date)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM stg_orders)),
fct_orders AS (SELECT o.order_id, o.user_id, coalesce(h.user_sk, c.user_sk) AS user_sk, order_status, currency, shipping_city, total_amount, order_date, o.created_at, o.updated_at, is_terminal
  FROM stg_orders o LEFT JOIN dim_users h ON o.user_id = h.user_id AND o.created_at >= h.valid_from AND (h.valid_to IS NULL OR o.created_at < h.valid_to)
  LEFT JOIN dim_users c ON o.user_id = c.user_id AND c.is_current),
fct_order_items AS (SELECT i.order_item_id, i.order_id, o.user_id, i.product_id, p.seller_id, p.category_id, i.quantity, i.unit_price, i.line_amount, o.order_status, o.order_date, i.created_at, i.updated_at
  FROM stg_order_items i JOIN stg_orders o USING (order_id) LEFT JOIN dim_products p ON i.product_id = p.product_id AND p.is_current),
fct_payments AS (SELECT p.payment_id, p.order_id, o.user_id, p.payment_method, p.amount, p.payment_status, o.order_status, o.order_date, p.created_at, p.updated_at FROM stg_payments p JOIN stg_orders o USING (order_id)),
fct_events AS (SELECT event_id, user_id, session_id, product_id, event_type, event_time, event_date, event_hour, city, device_type, platform_version, schema_version, consumed_at FROM stg_events),
revenue AS (SELECT * FROM stg_orders WHERE order_status IN ('paid', 'shipped', 'delivered')),
mart_daily_gmv AS (SELECT order_date AS date_key, count(*) AS orders, sum(total_amount) AS gmv, ((sum(total_amount) * 100)::BIGINT * 2 + count(*)) // (count(*) * 2) / 100.0::DOUBLE AS average_order_value, count(DISTINCT user_id) AS buyers
  FROM revenue GROUP BY order_date),
first_orders AS (SELECT user_id, date_trunc('month', min(order_date))::DATE AS cohort_month FROM revenue GROUP BY user_id),
activity AS (SELECT cohort_month, date_diff('month', cohort_month, date_trunc('month', order_date)::DATE)::INTEGER AS month_number, count(DISTINCT user_id) AS active_users FROM revenue JOIN first_orders USING (user_id) GROUP BY ALL),
mart_cohort_retention AS (SELECT a.cohort_month, s.active_users AS cohort_size, a.month_number, a.active_users, (a.active_users * 20000 + s.active_users) // (s.active_users * 2) / 10000.0::DOUBLE AS retention_rate
  FROM activity a JOIN activity s ON a.cohort_month = s.cohort_month AND s.month_number = 0),
mart_seller_performance AS (SELECT s.seller_id, s.seller_name, s.city, s.rating, count(DISTINCT order_id) AS orders, sum(quantity)::BIGINT AS units_sold, sum(line_amount) AS revenue,
    ((sum(unit_price) * 100)::BIGINT * 2 + count(*)) // (count(*) * 2) / 100.0::DOUBLE AS average_unit_price, count(DISTINCT product_id) AS distinct_products
  FROM fct_order_items f JOIN dim_sellers s ON f.seller_id = s.seller_id WHERE order_status IN ('paid', 'shipped', 'delivered') GROUP BY ALL),
daily AS (SELECT event_date, count(DISTINCT session_id) AS sessions, count(DISTINCT session_id) FILTER (event_type = 'page_view') AS page_view_sessions, count(DISTINCT session_id) FILTER (event_type = 'add_to_cart') AS cart_sessions,
    count(DISTINCT session_id) FILTER (event_type = 'checkout') AS checkout_sessions, count(DISTINCT session_id) FILTER (event_type = 'purchase') AS purchase_sessions FROM fct_events GROUP BY event_date),
mart_funnel_daily AS (SELECT *, (cart_sessions * 20000 + page_view_sessions) // nullif(page_view_sessions * 2, 0) / 10000.0::DOUBLE AS view_to_cart_rate, (checkout_sessions * 20000 + cart_sessions) // nullif(cart_sessions * 2, 0) / 10000.0::DOUBLE AS cart_to_checkout_rate,
    (purchase_sessions * 20000 + checkout_sessions) // nullif(checkout_sessions * 2, 0) / 10000.0::DOUBLE AS checkout_to_purchase_rate, (purchase_sessions * 20000 + page_view_sessions) // nullif(page_view_sessions * 2, 0) / 10000.0::DOUBLE AS view_to_purchase_rate FROM daily),
steps AS (SELECT i::INTEGER AS step_order, step, count(DISTINCT session_id) AS sessions FROM (VALUES (1, 'page_view'), (2, 'add_to_cart'), (3, 'checkout'), (4, 'purchase')) v(i, step) LEFT JOIN fct_events ON event_type = step GROUP BY ALL),
mart_funnel_steps AS (SELECT s.step_order, s.step, s.sessions, (s.sessions * 20000 + e.n) // nullif(e.n * 2, 0) / 10000.0::DOUBLE AS share_of_entry, (s.sessions * 20000 + p.sessions) // nullif(p.sessions * 2, 0) / 10000.0::DOUBLE AS step_conversion_rate,
    sign(p.sessions - s.sessions) * ((abs(p.sessions - s.sessions) * 20000 + p.sessions) // nullif(p.sessions * 2, 0)) / 10000.0::DOUBLE AS drop_off_rate
  FROM steps s CROSS JOIN (SELECT max(sessions) AS n FROM steps) e LEFT JOIN steps p ON p.step_order = s.step_order - 1),
series AS (
  SELECT 'orders' AS entity, 'day' AS grain, created_at::DATE AS d, count(*) FILTER (created_at < TIMESTAMP '2001-01-01') AS s, count(*) AS w FROM fct_orders GROUP BY ALL
  UNION ALL SELECT 'order_items', 'day', created_at::DATE, count(*) FILTER (created_at < TIMESTAMP '2001-01-01'), count(*) FROM fct_order_items GROUP BY ALL
  UNION ALL SELECT 'payments', 'day', created_at::DATE, count(*) FILTER (created_at < TIMESTAMP '2001-01-01'), count(*) FROM fct_payments GROUP BY ALL
  UNION ALL SELECT 'users', 'total', NULL, (SELECT count(*) FROM customer), count(DISTINCT user_id) FROM dim_users
  UNION ALL SELECT 'products', 'total', NULL, (SELECT count(*) FROM part), count(DISTINCT product_id) FROM dim_products
  UNION ALL SELECT 'sellers', 'total', NULL, (SELECT count(*) FROM supplier), count(DISTINCT seller_id) FROM dim_sellers
  UNION ALL SELECT 'categories', 'total', NULL, (SELECT count(*) FROM kinds), count(DISTINCT category_id) FROM dim_categories
  UNION ALL SELECT 'events', 'total', NULL, (SELECT count(*) FROM events WHERE event_type <> 'error'), count(*) FROM fct_events),
row_counts AS (SELECT TIMESTAMP '2024-01-31' AS checked_at, entity, grain, d AS check_date, s AS source_count, w AS warehouse_count, s - w AS difference, CASE WHEN s = w THEN 'ok' ELSE 'mismatch' END AS status FROM series),
runs AS (SELECT date_trunc('day', ts) + INTERVAL 20 HOUR AS started_at, count(*) AS records, count(*) FILTER (event_type = 'error') AS malformed, count(*) FILTER (event_type <> 'error') + count(*) FILTER (event_type <> 'error' AND event_id % 50 = 0) AS cleaned,
  count(*) FILTER (event_type <> 'error' AND event_id % 50 = 0) AS duplicates FROM events GROUP BY ALL),
last_runs AS (SELECT coalesce(sum(records), 0)::DOUBLE AS records, coalesce(sum(malformed), 0)::DOUBLE AS malformed, round(date_diff('second', max(started_at), TIMESTAMP '2024-01-31') / 3600.0, 2) AS age FROM runs WHERE started_at >= TIMESTAMP '2024-01-30'),
last_cleans AS (SELECT coalesce(sum(cleaned), 0)::DOUBLE AS cleaned, coalesce(sum(duplicates), 0)::DOUBLE AS duplicates, round(date_diff('second', max(started_at) + INTERVAL 1 HOUR, TIMESTAMP '2024-01-31') / 3600.0, 2) AS age FROM runs WHERE started_at + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-30'),
newest AS (
  SELECT 'categories' AS t, max(updated_at) AS newest_at FROM stg_categories UNION ALL SELECT 'order_items', max(updated_at) FROM stg_order_items UNION ALL SELECT 'orders', max(updated_at) FROM stg_orders
  UNION ALL SELECT 'payments', max(updated_at) FROM stg_payments UNION ALL SELECT 'products', (SELECT max(updated_at) FROM stg_products) UNION ALL SELECT 'sellers', max(updated_at) FROM stg_sellers UNION ALL SELECT 'users', (SELECT max(updated_at) FROM stg_users)),
last_extracts AS (SELECT t, round(date_diff('microsecond', newest_at, TIMESTAMP '2024-01-31') / 3600000000.0, 2) AS age FROM newest WHERE newest_at IS NOT NULL),
health_rows AS (
  SELECT 'extract' AS component, t AS entity, 'last_run_age_hours' AS metric, age AS metric_value, CASE WHEN age >= 6 THEN 'error' WHEN age >= 3 THEN 'warn' ELSE 'ok' END AS status FROM last_extracts
  UNION ALL SELECT 'stream', '', 'records_last_24h', records, 'ok' FROM last_runs
  UNION ALL SELECT 'stream', '', 'malformed_last_24h', malformed, CASE WHEN malformed / records >= 0.1 THEN 'error' WHEN malformed / records >= 0.02 THEN 'warn' ELSE 'ok' END FROM last_runs
  UNION ALL SELECT 'stream', '', 'last_run_age_hours', age, CASE WHEN age >= 3 THEN 'error' WHEN age >= 1 THEN 'warn' ELSE 'ok' END FROM last_runs
  UNION ALL SELECT 'clean', '', 'rows_cleaned_last_24h', cleaned, 'ok' FROM last_cleans
  UNION ALL SELECT 'clean', '', 'duplicates_removed_last_24h', duplicates, 'ok' FROM last_cleans
  UNION ALL SELECT 'clean', '', 'last_run_age_hours', age, CASE WHEN age >= 6 THEN 'error' WHEN age >= 2 THEN 'warn' ELSE 'ok' END FROM last_cleans
  UNION ALL SELECT 'reconcile', '', 'checks_run', count(*)::DOUBLE, 'ok' FROM row_counts
  UNION ALL SELECT 'reconcile', '', 'checks_failed', count(*) FILTER (status <> 'ok')::DOUBLE, CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'error' ELSE 'ok' END FROM row_counts),
health AS (SELECT TIMESTAMP '2024-01-31' AS checked_at, component, entity, metric, metric_value::DOUBLE AS metric_value, status FROM health_rows),
live AS (SELECT * FROM stg_events)
"""


def sql(query: str) -> str:
    return f"WITH {_RAW.strip()}\n{query}"


def model(name: str, *money: str) -> str:
    """A whole model; ``money`` columns as DOUBLE."""
    casts = ", ".join(f"{c}::DOUBLE AS {c}" for c in money)
    return sql(f"SELECT * {f'REPLACE ({casts}) ' if casts else ''}FROM {name}")
