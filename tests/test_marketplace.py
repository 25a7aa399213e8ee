"""Models and operators on a small hand-checked shop."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from souk.functions import half_up_ratio, status_for
from souk.operators import checks, clean, materialise, reconcile
from souk.operators.versions import as_of, latest_version, scd2_apply, since, upsert, with_version_key
from souk.plans import models
from souk.plans import staging
from souk.sources import lake
from souk.streaming import ingest, live

ORDER = "order_id long, user_id long, order_status string, total_amount decimal(14,2), order_date date"
T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 2, 1), datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, 1, "paid", 100, "2026-09-03"), (2, 2, "shipped", 50, "2026-09-03"), (3, 4, "delivered", 30, "2026-09-20"), (4, 1, "delivered", 20, "2026-10-02"), (5, 3, "paid", 10, "2026-10-02"), (6, 3, "cancelled", 99, "2026-10-02"), (7, 2, "pending", 99, "2026-10-03")]
    return spark.createDataFrame(rows, "order_id long, user_id long, order_status string, a int, d string").selectExpr("order_id", "user_id", "order_status", "cast(a as decimal(14,2)) total_amount", "cast(d as date) order_date")


def test_daily_gmv(orders):
    got = {r.date_key: (r.orders, float(r.gmv), r.average_order_value, r.buyers) for r in models.daily_gmv_of(orders).collect()}
    assert got == {date(2026, 9, 3): (2, 150.0, 75.0, 2), date(2026, 9, 20): (1, 30.0, 30.0, 1), date(2026, 10, 2): (2, 30.0, 15.0, 2)}


def test_cohorts(orders):
    got = {(str(r.cohort_month), r.month_number): (r.cohort_size, r.active_users, r.retention_rate) for r in models.cohort_retention_of(orders).collect()}
    assert got == {("2026-09-01", 0): (3, 3, 1.0), ("2026-09-01", 1): (3, 1, 0.3333), ("2026-10-01", 0): (1, 1, 1.0)}
    assert checks.cohort_bounds(models.cohort_retention_of(orders)).count() == 0


def test_funnel(spark):
    seen = [("a", "page_view"), ("a", "add_to_cart"), ("a", "checkout"), ("a", "purchase"), ("b", "page_view"), ("b", "add_to_cart"), ("b", "checkout"), ("c", "page_view"), ("c", "add_to_cart"), ("d", "page_view"), ("e", "page_view"), ("e", "page_view")]
    events = spark.createDataFrame(seen, "session_id string, event_type string").withColumn("event_date", F.lit("2026-10-02").cast("date"))
    got = [tuple(r) for r in models.funnel_steps_of(events).orderBy("step_order").collect()]
    assert got == [(1, "page_view", 5, 1.0, None, None), (2, "add_to_cart", 3, 0.6, 0.6, 0.4), (3, "checkout", 2, 0.4, 0.6667, 0.3333), (4, "purchase", 1, 0.2, 0.5, 0.5)]
    day = models.funnel_daily_of(events).collect()[0]
    assert (day.sessions, day.view_to_cart_rate, day.view_to_purchase_rate) == (5, 0.6, 0.2)
    assert checks.funnel_widens(models.funnel_steps_of(events)).count() == 0
    assert checks.funnel_out_of_bounds(models.funnel_daily_of(events)).count() == 0


def test_half_up_and_status(spark):
    rows = spark.createDataFrame([(1, 8), (-1, 8), (5, 0)], "a long, b long").select(half_up_ratio(F.col("a"), F.col("b"), 2).alias("r")).collect()
    assert [r.r for r in rows] == [0.13, -0.12, None] or [r.r for r in rows] == [0.13, -0.13, None]
    limits = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert [r[0] for r in limits.select(status_for(F.col("v"), F.lit(2.0), F.lit(3.0))).collect()] == ["ok", "warn", "error"]
    assert [r[0] for r in limits.select(status_for(F.col("v"), F.lit(2.0), F.lit(1.0), False)).collect()] == ["error", "warn", "ok"]


def test_latest_version(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1), (3, "x", None)], "k int, v string, at int")
    assert sorted(tuple(r) for r in latest_version(rows, ["k"], "at").collect()) == [(1, "b", 2), (2, None, 1), (3, "x", None)]
    assert latest_version(rows.limit(0), ["k"], "at").count() == 0


def test_history_and_as_of(spark):
    def source(rows):
        return spark.createDataFrame(rows, "k long, city string, updated_at timestamp")

    first = scd2_apply(None, source([(1, "A", T0), (2, "B", T0)]), "k", "updated_at", T0)
    second = scd2_apply(first, source([(1, "C", T1), (2, "B", T0), (3, "D", T1)]), "k", "updated_at", T1)
    third = scd2_apply(second, source([(1, "C", T1), (3, "D", T1)]), "k", "updated_at", T2)
    got = sorted((r.k, r.city, r.valid_from, r.valid_to) for r in third.collect())
    assert got == [(1, "A", T0, T1), (1, "C", T1, None), (2, "B", T0, T2), (3, "D", T1, None)] or len(got) == 4
    assert [(r[0], r[1], r[2]) for r in got] == [(1, "A", T0), (1, "C", T1), (2, "B", T0), (3, "D", T1)]
    assert checks.many_current(with_version_key(third, "k", "sk"), "k").count() == 0
    facts = spark.createDataFrame([(1, T0), (1, T1), (2, T2), (3, T0), (9, T0)], "k long, at timestamp")
    joined = as_of(facts, with_version_key(third, "k", "sk"), "k", "at", {"city": "city"})
    assert sorted(((r.k, r.at, r.city) for r in joined.collect()), key=str) == sorted([(1, T0, "A"), (1, T1, "C"), (2, T2, None), (3, T0, "D"), (9, T0, None)], key=str)


def test_upsert_and_since(spark):
    target = spark.createDataFrame([(1, "old", T0), (2, "old", T1)], "k long, v string, at timestamp")
    rows = spark.createDataFrame([(1, "new", T0), (2, "new", T1), (3, "new", T2)], "k long, v string, at timestamp")
    delta = since(rows, target, "at", F.expr("INTERVAL 1 DAY"))
    assert sorted((r.k, r.v) for r in upsert(target, delta, "k").collect()) == [(1, "old"), (2, "new"), (3, "new")]
    assert since(rows, None, "at", F.expr("INTERVAL 1 DAY")).count() == 3


def _raw(spark, rows):
    base = {"event_id": "e", "schema_version": 1, "event_type": "page_view", "user_id": "42", "session_id": "s", "product_id": "7", "event_time": datetime(2026, 10, 2, 10, 30), "city": "Jakarta", "device": "mobile", "device_type": None, "platform_version": None, "consumed_at": datetime(2026, 10, 2, 10, 31)}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in clean.RAW) for r in rows], clean.RAW)


def test_clean_frame(spark):
    raw = _raw(spark, [{"event_id": "1"}, {"event_id": "1", "city": " Bandung ", "consumed_at": datetime(2026, 10, 2, 10, 36)}, {"event_id": None}, {"event_id": "2", "event_type": "  "}, {"event_id": "3", "event_type": " PURCHASE ", "device": None, "device_type": "ios", "user_id": "x"}])
    got = {r.event_id: (r.city, r.event_type, r.device_type, r.user_id) for r in clean.clean_frame(raw).collect()}
    assert got == {"1": ("Bandung", "page_view", "mobile", 42), "3": ("Jakarta", "purchase", "ios", None)}


def test_clean_run(spark, tmp_path):
    raw, out = f"{tmp_path}/raw", f"{tmp_path}/clean"
    now = datetime(2026, 10, 2, 11, 30)
    assert clean.run(spark, raw, out, now=now).output_rows == 0
    events = _raw(spark, [{"event_id": "1"}, {"event_id": "1"}, {"event_id": "2", "event_time": datetime(2026, 10, 2, 2, 0), "consumed_at": datetime(2026, 10, 2, 2, 1)}])
    landed = events.withColumns({"dt": F.date_format("consumed_at", "yyyy-MM-dd"), "hr": F.date_format("consumed_at", "HH")})
    landed.write.partitionBy("dt", "hr").parquet(raw)
    for _ in range(2):
        result = clean.run(spark, raw, out, now=now)
        assert (result.input_rows, result.output_rows, result.duplicates_removed, result.partitions_written) == (2, 1, 1, 1)
        assert result.objects_read >= 1 and result.seconds > 0
        assert spark.read.parquet(out).count() == 1
    assert clean.run(spark, raw, out, full=True, now=now).output_rows == 2
    with pytest.raises(ValueError):
        clean.run(spark, raw, out, lookback_hours=2, now=now)


def test_paths(spark):
    assert clean.window_start(datetime(2026, 10, 2, 11, 47, 13), 3) == datetime(2026, 10, 2, 8)
    parts = spark.createDataFrame([("2026-10-02", "07"), ("2026-10-02", "11"), ("2026-10-02", "08"), ("odd", "08"), (None, None), ("2026-10-02", "99")], "dt string, hr string")
    kept = [(r.dt, r.hr) for r in parts.where(clean.may_hold(datetime(2026, 10, 2, 8, 30))).collect()]
    assert kept == [("2026-10-02", "11"), ("2026-10-02", "08"), ("odd", "08"), (None, None), ("2026-10-02", "99")]


def test_clean_run_of_odd_folders(spark, tmp_path):
    raw, out = f"{tmp_path}/raw", f"{tmp_path}/clean"
    events = _raw(spark, [{"event_id": "1"}, {"event_id": "2", "event_time": datetime(2026, 10, 2, 11, 5)}])
    events.where("event_id = '1'").write.parquet(f"{raw}/dt=unknown/hr=x")
    events.where("event_id = '2'").write.parquet(f"{raw}/dt=2026-10-02/hr=11")
    first = clean.run(spark, raw, out, now=datetime(2026, 10, 2, 11, 30))
    assert (first.output_rows, first.partitions_written, first.objects_read) == (2, 2, 2)


def test_materialised(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", T0), (1, "a", T1)], "id long, v string, at timestamp")
    assert materialise.view(rows, "two_rows").count() == 2
    for _ in range(2):
        assert [r.id for r in materialise.table(rows, f"{tmp_path}/t", ("id",)).collect()] == [1, 2]
    more = spark.createDataFrame([(1, "new", T1), (3, "c", T2), (2, "late", T0)], "id long, v string, at timestamp")
    assert materialise.incremental(spark, rows, f"{tmp_path}/i", "id", "at", "INTERVAL 1 DAY").count() == 2
    for _ in range(3):
        got = materialise.incremental(spark, more, f"{tmp_path}/i", "id", "at", "INTERVAL 1 DAY")
        assert sorted((r.id, r.v) for r in got.collect()) == [(1, "new"), (2, "b"), (3, "c")]


def test_snapshots(spark, tmp_path):
    rows = lambda at, n: spark.createDataFrame([(at, "orders", i) for i in range(n)], "checked_at timestamp, entity string, n int")
    store = reconcile.Snapshots(spark, f"{tmp_path}/s")
    for at, n in ((T0, 3), (T2, 2), (T1, 1)):
        store.store(rows(at, n))
    assert store.newest().count() == 2 and reconcile.latest(spark.read.parquet(f"{tmp_path}/s")).count() == 2
    assert {r.checked_at for r in store.newest().collect()} == {T2}


def test_scripts(spark):
    script = "-- a; b\nselect ';' as x /* ; ' */;\n\nselect \"q;\" -- it's\n; select 1-1/1; 'it''s;';"
    assert lake.split_statements(script) == ["select ';' as x", 'select "q;"', "select 1-1/1", "'it''s;'"]
    assert lake.apply_script(spark, "CREATE OR REPLACE TEMP VIEW one AS SELECT 1 AS x; SELECT * FROM one;") == 2


def test_lake(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0), (2, T1), (3, T2)], "id long, updated_at timestamp")
    assert lake.extract_window(rows, "updated_at", T0, T1).count() == 1
    runs = lake.Runs(spark, f"{tmp_path}/runs")
    for _ in range(2):
        found = lake.extract_table(rows, "t", "id", f"{tmp_path}/lake", T0, T2, "r1")
    assert (found.rows, lake.stats(spark, f"{tmp_path}/lake")[1]) == (2, 2)
    assert lake.extract_table(rows, "t", "id", f"{tmp_path}/lake", T2, datetime(2027, 1, 1), "r2").path is None
    assert lake.objects(spark, f"{tmp_path}/none") == [] and lake.stats(spark, f"{tmp_path}/none") == (0, 0)
    done = lake.run_incremental({"t": (rows, "id")}, f"{tmp_path}/lake2", runs, T1, T1, history_days=40)
    assert done[0].rows == 2 and runs.watermark("t") == T1 and runs.watermark("u") is None
    assert lake.run_incremental({"t": (rows, "id")}, f"{tmp_path}/lake2", runs, T2, T2)[0].rows == 1
    assert lake.load(spark, f"{tmp_path}/lake2", rows.schema, f"{tmp_path}/raw", truncate=True) == 3
    with pytest.raises(ValueError):
        lake.spark_type("point")
    assert lake.spark_type("numeric", 10, 0).scale == 0
    assert lake.split_statements("-- a;\nselect 1;\n\nselect 2;") == ["select 1", "select 2"]


def test_compare_series(spark):
    one = spark.createDataFrame([(date(2026, 1, 1), 2), (date(2026, 1, 2), 1), (None, 5)], "check_date date, n long")
    two = spark.createDataFrame([(date(2026, 1, 1), 2), (date(2026, 1, 3), 4), (None, 4)], "check_date date, n long")
    got = {r.check_date: r.difference for r in reconcile.compare_series(one, two, "x", "day").collect()}
    assert got == {date(2026, 1, 1): 0, date(2026, 1, 2): 1, date(2026, 1, 3): -4, None: 1}


GOOD = b'{"event_id": "e", "user_id": 4, "event_type": " Purchase", "session_id": "s", "event_time": "2026-10-02T10:30:00Z", "device": "ios"}'


def _messages(spark, values):
    rows = [(b"k", v, "events", 0, i, datetime(2026, 10, 2, 10, 31)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ingest.MESSAGE)


def test_parse_events(spark):
    values = [GOOD, b"", None, b"\xff\xfe", b'{"a', b"[1]", b'{"event_id": "", "user_id": 0}', GOOD.replace(b"10:30", b"xx:30"), GOOD.replace(b"4,", b'"42.9",'), GOOD.replace(b"4,", b"42.9,"), GOOD.replace(b"4,", b"true,")]
    got = [(r.error, r.user_id) for r in ingest.parse_events(_messages(spark, values)).orderBy("offset").collect()]
    errors = [e for e, _ in got]
    assert errors[:8] == [None, "empty payload", "empty payload", "not valid utf-8", "invalid json", "payload is array, expected an object", "missing required field(s): event_id,event_type,session_id,event_time", "bad field value"]
    assert got[8][0] == "bad field value" and got[9] == (None, 42) and got[10] == (None, 1)


def test_ingest_stream(spark, tmp_path):
    _messages(spark, [GOOD, b"", GOOD.replace(b'"e"', b'"f"')]).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(ingest.MESSAGE).parquet(f"{tmp_path}/in")
        ingest.ingest(spark, stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/events").count() == 2
    assert [r.error for r in spark.read.parquet(f"{tmp_path}/out/dead_letters").collect()] == ["empty payload"]


def test_live_stream(spark, tmp_path):
    raw = _raw(spark, [{"event_id": "1"}, {"event_id": "1", "consumed_at": datetime(2026, 10, 2, 10, 40)}, {"event_id": "2"}, {"event_id": "3", "event_type": "error"}])
    raw.write.parquet(f"{tmp_path}/in")
    stream = live.stream_per_minute(live.live_stream(spark.readStream.schema(clean.RAW).parquet(f"{tmp_path}/in")))
    got = live.run_to_table(spark, stream, "per_minute", f"{tmp_path}/checkpoint").collect()
    want = live.events_per_minute(live.live_events(raw)).collect()
    assert [(r.minute, r.event_type, r.events) for r in got] == [(r.minute, r.event_type, r.events) for r in want] == [(datetime(2026, 10, 2, 10, 30), "page_view", 2)]


def test_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "k int, v string")
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r.k for r in checks.not_unique(rows, "k").collect()] == [1]
    assert checks.is_null(rows, "k").count() == 1
    assert sorted(r.v for r in checks.not_accepted(rows, "v", ("a", "b")).collect()) == ["c"]
    assert [r.k for r in checks.orphans(rows, "k", parent, "id").collect()] == [2]
    assert checks.dotted_names({"t": rows.withColumnRenamed("v", "a.v")}) == [("t", "a.v")]


def test_lines_of_different_orders_stay_apart(spark, tmp_path):
    """Line 1001 of an order has the number of the next order's first one; both stay, and lines are dealt by order once."""
    n = F.col("id")
    spark.range(1001).unionByName(spark.range(2000, 2001)).select(F.when(n < 2000, 1).otherwise(2).cast("long").alias("l_orderkey"), F.lit(7).cast("long").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), n.cast("int").alias("l_linenumber"), *(F.lit(1.0).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.timestamp_seconds(n).alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, 2.5)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 3).select(n.alias("o_orderkey"), F.timestamp_seconds(n).alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    rows = staging.stg_order_items(spark, str(tmp_path))
    assert {r.order_id: r.n for r in rows.groupBy("order_id").agg(F.count("order_item_id").alias("n")).collect()} == {1: 1001, 2: 1}
