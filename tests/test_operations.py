"""Topics, bounded runs, their log, keyed views and stored models."""

from __future__ import annotations

import threading
import time
from collections import Counter
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from souk.operators import reconcile
from souk.plans import operations, store
from souk.sources import messages as topics
from souk.sources.messages import Segment, Topic, Written, admit, messages, ranges, send
from souk.sources.runlog import Run, RunListener, RunLog
from souk.streaming.consume import consume
from souk.streaming.ingest import TooManyMalformed, dead_letters, events, ingest, parse_events
from souk.streaming.keyed import ROWS_OF_STATE, KeyedView, keep, state_partitions

T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 2, 1), datetime(2026, 3, 1)
GOOD = '{"event_id": "e%d", "user_id": 4, "event_type": "purchase", "session_id": "s", "event_time": "2026-10-02T10:30:00Z"}'


def numbered(spark, n, start=0, bad=0):
    """Messages in order; every ``bad``-th is broken."""
    value = F.when(F.lit(bool(bad)) & (F.col("id") % max(1, bad) == 0), "{").otherwise(F.format_string(GOOD, F.col("id")))
    return spark.range(start, start + n, 1, 1).select(value.cast("binary").alias("value"), F.col("id").cast("string").alias("key"), F.timestamp_micros("id").alias("timestamp"))


def offsets(rows):
    return sorted((r.partition, r.offset) for r in rows.select("partition", "offset").collect())


def test_topic_by_offsets(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert messages(spark, "t", path).count() == 0
    placed = spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("value"), (F.col("id") % 3).cast("int").alias("partition"))
    send(placed, "t", path)
    send(placed.limit(0), "t", path)
    send(placed.where("id < 6"), "t", path)
    rows = messages(spark, "t", path)
    assert rows.columns == ["key", "value", "topic", "partition", "offset", "timestamp"]
    assert offsets(rows) == [(p, o) for p, n in ((0, 36), (1, 35), (2, 35)) for o in range(n)]
    order = [int(r.value) for r in rows.where("partition = 1").orderBy("offset").collect()]
    assert order == [*range(1, 100, 3), 1, 4]
    part = messages(spark, "t", path, startingOffsets='{"0": 30, "1": -1}', endingOffsets='{"0": 34, "2": 2}', rowsPerTask=3)
    assert offsets(part) == [(0, 30), (0, 31), (0, 32), (0, 33), (2, 0), (2, 1)]
    assert part.rdd.getNumPartitions() == 3
    assert messages(spark, "t", path, startingOffsets="latest").count() == 0
    with pytest.raises(Exception, match="isn't between"):
        messages(spark, "t", path, startingOffsets='{"0": 37}').count()


def test_keys_keep_their_partition_and_order(spark, tmp_path):
    rows = spark.range(0, 200, 1, 2).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("key"), F.col("id").cast("string").alias("value"))
    send(rows, "t", f"{tmp_path}", 3)
    got = messages(spark, "t", f"{tmp_path}").selectExpr("cast(key as string) key", "cast(cast(value as string) as int) value", "partition", "offset").orderBy("partition", "offset").collect()
    of_key = {k: {r.partition for r in got if r.key == k} for k in {r.key for r in got}}
    assert all(len(p) == 1 for k, p in of_key.items() if k) and len(of_key[None]) == 3
    for key in of_key:
        own = [r.value for r in got if r.key == key]
        assert key is None or own == sorted(own)


def test_commits_are_whole_and_known(tmp_path):
    own = Topic(f"{tmp_path}", "t")
    writer = topics._StreamWriter({"path": f"{tmp_path}", "topic": "t", "writer": "w"})
    batch = pa.RecordBatch.from_pydict({"value": ["a", "b", None]})
    first = writer.write(iter([batch]))
    assert own.segments() == []  # nothing is seen before the commit
    writer.commit([first, None, Written([])], 0)
    again = writer.write(iter([batch]))
    writer.commit([again], 0)  # a batch that is written again
    assert [(s.partition, s.first, s.rows) for s in own.segments()] == [(0, 0, 3)]
    lost = writer.write(iter([batch]))
    writer.abort([lost, None], 1)
    files = {x.base_name for x in own.store.get_file_info(pa.fs.FileSelector(f"{own.root}/data"))}
    assert files == {s.file for s in own.segments()}
    writer.commit([writer.write(iter([batch]))], 1)
    assert [(s.first, s.rows) for s in own.segments()] == [(0, 3), (3, 3)]


def test_admission_and_ranges():
    segments = [Segment(0, 0, 50, 500, "a"), Segment(0, 50, 50, 500, "b"), Segment(1, 0, 20, 100, "c")]
    assert admit({}, {0: 100, 1: 20}, segments) == {0: 100, 1: 20}
    assert admit({}, {0: 100, 1: 20}, segments, 12) == {0: 10, 1: 2}
    assert admit({0: 95, 1: 19}, {0: 100, 1: 20}, segments, 4) == {0: 99, 1: 19}
    assert admit({0: 100, 1: 20}, {0: 100, 1: 20}, segments, 4) == {0: 100, 1: 20}
    assert admit({}, {0: 100, 1: 20}, segments, None, 1) == {0: 0, 1: 20}  # a file at least
    assert admit({}, {0: 100, 1: 20}, segments, None, 600) == {0: 50, 1: 20}
    done, rounds = {}, 0
    while done != {0: 100, 1: 20}:
        done, rounds = admit(done, {0: 100, 1: 20}, segments, 7), rounds + 1
    assert rounds == 18
    cut = ranges(segments, {0: 45, 1: 20}, {0: 60, 1: 20}, 10)
    assert [(r.partition, r.parts) for r in cut] == [(0, [("a", 45, 5, 45), ("b", 0, 5, 50)]), (0, [("b", 5, 5, 55)])]


def lake_ids(spark, path):
    return Counter(r.event_id for r in spark.read.parquet(f"{path}/lake/events").select("event_id").collect())


def test_bounded_runs_go_on_without_loss(spark, tmp_path):
    path, log = f"{tmp_path}", RunLog(spark, f"{tmp_path}/runs")
    send(numbered(spark, 100, bad=10), "t", path, 3)

    def run(**limits):
        return consume(spark, path, "t", f"{path}/lake", f"{path}/checkpoint", log=log, now=lambda: T1, **limits)

    first = run(batch_size=20, max_messages=50, run_id="a")
    assert (first.records, first.batches) == (50, 3)
    assert sum(lake_ids(spark, path).values()) == 50 - first.malformed
    send(numbered(spark, 20, 100), "t", path, 3)
    second = run(batch_size=30, run_id="b")
    assert (second.records, first.malformed + second.malformed) == (70, 10)
    assert lake_ids(spark, path) == Counter(f"e{i}" for i in range(120) if i >= 100 or i % 10)
    assert run(run_id="c").records == 0
    began = time.monotonic()
    assert run(max_seconds=1.0, run_id="d").records == 0 and time.monotonic() - began >= 1
    rows = {r.run_id: (r.records, r.malformed) for r in log.of("stream", "records", "malformed").collect()}
    assert rows == {"a": (50, first.malformed), "b": (70, second.malformed), "c": (0, 0), "d": (0, 0)}


def test_a_failed_run_is_logged_and_repeated(spark, tmp_path):
    path, log = f"{tmp_path}", RunLog(spark, f"{tmp_path}/runs")
    send(numbered(spark, 40, bad=4), "t", path)
    with pytest.raises(Exception, match="malformed messages") as caught:
        consume(spark, path, "t", f"{path}/lake", f"{path}/checkpoint", batch_size=10, most_malformed=2, log=log, run_id="r")
    assert TooManyMalformed.__name__ in str(caught.value)
    assert [(r.run_id, r.status) for r in log.all().collect()] == [("r", "failed")] and log.of("stream").count() == 0
    done = consume(spark, path, "t", f"{path}/lake", f"{path}/checkpoint", batch_size=10, log=log, run_id="r")
    assert (done.records, done.malformed) == (40, 10)  # the failed batch too
    assert lake_ids(spark, path) == Counter(f"e{i}" for i in range(40) if i % 4)
    assert spark.read.parquet(f"{path}/lake/dead_letters").count() == 10
    assert [(r.run_id, r.status) for r in log.all().collect()] == [("r", "ok")]


def test_run_log(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/runs")
    assert log.all().count() == 0 and log.watermark("extract", "orders") is None
    for rows in (5, 7):  # recorded again
        log.record("extract", "r1", Run(T0, T1, "orders", window_end=T1, metrics={"rows": rows}), Run(T0, T1, "users", window_end=T0))
    log.record("extract", "2026-01-01", Run(T1, T2, "orders", window_end=T2, status="failed"))
    log.record("clean", "r1", Run(T0, T1))
    assert {(r.run_id, r.entity, r.rows) for r in log.of("extract", "rows").collect()} == {("r1", "orders", 7), ("r1", "users", 0)}
    assert log.watermark("extract", "orders") == T1 and log.watermark("extract", "sellers") is None
    assert {r.run_id for r in log.all().collect()} == {"r1", "2026-01-01"}


def test_health_of_empty_logs(spark, tmp_path):
    counts = reconcile.compare_series(*[spark.createDataFrame([], "check_date date, n long")] * 2, "x", "day")
    rows = {(r.component, r.metric): (r.metric_value, r.status) for r in reconcile.health(RunLog(spark, f"{tmp_path}/none"), counts, T2).collect()}
    assert rows["stream", "last_run_age_hours"] == (float("inf"), "error") and rows["stream", "malformed_last_24h"] == (0.0, "ok")
    assert rows["clean", "rows_cleaned_last_24h"] == (0.0, "ok") and ("extract", "last_run_age_hours") not in rows


def test_listener_records_queries(spark, tmp_path):
    log = RunLog(spark, f"{tmp_path}/runs")
    listener = RunListener(log)
    spark.streams.addListener(listener)
    try:
        send(numbered(spark, 30), "t", f"{tmp_path}")
        for name, fail in (("good", False), ("bad", True)):
            source = messages(spark, "t", f"{tmp_path}", stream=True, maxOffsetsPerTrigger=10)
            rows = source.select(F.when(F.lit(fail), F.raise_error(F.lit("broken"))).otherwise(F.col("offset").cast("string")))
            query = rows.writeStream.format("noop").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(processingTime="0 seconds").start()
            try:
                query.processAllAvailable()
            except Exception:  # noqa: BLE001
                assert fail
            query.stop()
            assert listener.wait_for(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    got = {r.entity: (r.status, r.metrics["records"], r.metrics["batches"]) for r in log.all().collect()}
    assert got["good"] == ("ok", 30, 3) and got["bad"][0] == "failed"


def test_keyed_view(spark, tmp_path):
    def rows(*found):
        return spark.createDataFrame(found, "k string, n long")

    view = KeyedView(spark, f"{tmp_path}/v", ["k"], "k string, n long")

    def now():
        return sorted((r.k, r.n) for r in view.read().collect())

    assert now() == []
    view.compact()
    for _ in range(2):  # a batch that is replayed changes nothing
        view.upsert(rows(("a", 1), ("b", 1)), 0)
    view.upsert(rows(("b", 2), ("c", 1)), 1)
    assert now() == [("a", 1), ("b", 2), ("c", 1)]
    view.compact()
    view.compact()
    view.upsert(rows(("b", 99)), 1)  # folded in before
    view.upsert(rows(("d", 4), ("a", 5)), 2)
    assert now() == [("a", 5), ("b", 2), ("c", 1), ("d", 4)]
    view.upsert(rows(("a", 6)), 10)
    view.upsert(rows(("a", 7)), 9)
    view.compact()
    assert now() == [("a", 6), ("b", 2), ("c", 1), ("d", 4)]


def test_a_stream_keeps_counts(spark, tmp_path):
    path = f"{tmp_path}"
    view = KeyedView(spark, f"{path}/v", ["key"], "key string, n long")
    for start in (0, 30):
        send(numbered(spark, 30, start).withColumn("key", (F.col("key").cast("int") % 4).cast("string")), "t", path)
        source = messages(spark, "t", path, stream=True, group="g", maxOffsetsPerTrigger=7)
        counts = source.groupBy(F.col("key").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        query = keep(view, counts, f"{path}/checkpoint", {"processingTime": "0 seconds"}, compact_every=2)
        query.processAllAvailable()
        query.stop()
    assert {r.key: r.n for r in view.read().collect()} == {str(k): 15 for k in range(4)}


def test_stored_models(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t/one.parquet")
    built = []

    @store.kept
    def doubled(spark, folder):
        built.append(folder)
        return spark.read.parquet(f"{folder}/one.parquet").selectExpr("id * 2 AS id")

    for _ in range(2):
        assert sorted(r.id for r in doubled(spark, f"{tmp_path}/t").collect()) == [0, 2, 4]
    assert len(built) == 1
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/t/one.parquet")  # another state of the folder, another store
    assert sorted(r.id for r in doubled(spark, f"{tmp_path}/t").collect()) == [0, 0, 2, 4] and len(built) == 2


def test_bounded_series(spark):
    rows = spark.createDataFrame([(T0, T0), (T0, T0), (T2, T2)], "created_at timestamp, updated_at timestamp")
    assert reconcile.bounded_series(rows, lambda: pytest.fail("not read"), "x", None) is None
    got = reconcile.bounded_series(rows, lambda: rows.limit(1), "x", T1).collect()
    assert [(r.source_count, r.warehouse_count, r.status) for r in got] == [(2, 1, "mismatch")]
    assert operations.newest(rows.limit(0), "updated_at") is None


def test_filters_stay_above_parsing(spark, tmp_path):
    """Each text is parsed once, whichever columns a filter asks for."""
    send(spark.createDataFrame([(b'{"event_id": "a"}',), (b"[",)], "value binary"), "t", str(tmp_path))
    for rows in (events(parse_events(messages(spark, "t", str(tmp_path)))), dead_letters(parse_events(messages(spark, "t", str(tmp_path))))):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_hours_are_written_once(spark, tmp_path):
    """Messages of one hour that many tasks read make one file, and a large range of a partition many tasks."""
    at = datetime(2026, 1, 1, 5)
    send(spark.range(400, numPartitions=1).select(F.lit(b"[").alias("value"), F.lit(at).alias("timestamp")), "t", str(tmp_path))
    assert messages(spark, "t", str(tmp_path), rowsPerTask=20).rdd.getNumPartitions() == 20
    query = ingest(spark, messages(spark, "t", str(tmp_path), stream=True, rowsPerTask=20), f"{tmp_path}/out", f"{tmp_path}/checkpoint", {"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert len(list((tmp_path / "out/dead_letters").rglob("*.parquet"))) <= 4
    assert spark.read.parquet(f"{tmp_path}/out/dead_letters").count() == 400


def test_ranges_skip_row_groups(spark, tmp_path):
    send(spark.range(25_000, numPartitions=1).select(F.col("id").cast("string").cast("binary").alias("value")), "t", str(tmp_path))
    for first, last in ((0, 25_000), (9_999, 10_001), (10_000, 20_000), (20_001, 25_000), (24_999, 25_000), (25_000, 25_000)):
        rows = messages(spark, "t", str(tmp_path), startingOffsets=f'{{"0": {first}}}', endingOffsets=f'{{"0": {last}}}', rowsPerTask=7_000)
        assert [(r.offset, int(r.value)) for r in rows.orderBy("offset").collect()] == [(i, i) for i in range(first, last)]


def test_many_hours_are_written_by_all_cores(spark, tmp_path):
    """A small batch over many hours makes a file an hour, written by several tasks rather than by one."""
    send(spark.range(200, numPartitions=1).select(F.lit(b"[").alias("value"), F.timestamp_seconds(F.col("id") % 40 * 3600).alias("timestamp")), "t", str(tmp_path))
    query = ingest(spark, messages(spark, "t", str(tmp_path), stream=True), f"{tmp_path}/out", f"{tmp_path}/checkpoint", {"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    files = list((tmp_path / "out/dead_letters").rglob("*.parquet"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
    assert spark.read.parquet(f"{tmp_path}/out/dead_letters").count() == 200


def test_parts_of_the_operation_run_apart(spark, tmp_path, monkeypatch):
    """A query runs the part that it reads and no other; a part that failed is filled anew."""
    ran = []

    def fill(spark, folder, path, log):
        ran.append(path)
        spark.range(len(ran)).write.parquet(f"{path}/rows")
        if len(ran) == 1:
            raise ValueError("broken")
        log.record("clean", "r", Run(T0, T1))

    monkeypatch.setattr(operations, "PARTS", {"clean": fill, "extract": lambda *_: pytest.fail("not asked for")})
    with pytest.raises(ValueError, match="broken"):
        operations.operate(spark, str(tmp_path), "clean")
    path = operations.operate(spark, str(tmp_path), "clean")
    assert operations.operate(spark, str(tmp_path), "clean") == path == ran[1] != ran[0] and len(ran) == 2
    assert spark.read.parquet(f"{path}/rows").count() == 2 and RunLog(spark, f"{path}/runs").all().count() == 1


def test_state_goes_into_few_partitions(spark, tmp_path):
    """A stream's state isn't cut by the session's shuffle partitions, which stay as they were; more messages make more partitions."""
    path, before = f"{tmp_path}", spark.conf.get("spark.sql.shuffle.partitions")
    send(numbered(spark, 30), "t", path)
    counts = messages(spark, "t", path, stream=True).groupBy(F.col("key").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    view = KeyedView(spark, f"{path}/v", ["key"], "key string, n long")
    query = keep(view, counts, f"{path}/checkpoint", partitions=2)
    query.awaitTermination()
    assert view.read().count() == 30 and spark.conf.get("spark.sql.shuffle.partitions") == before != "2"
    assert sorted(x.name for x in (tmp_path / "checkpoint/state/0").iterdir() if x.name.isdigit()) == ["0", "1"]
    cores = spark.sparkContext.defaultParallelism
    assert state_partitions(spark, 10) == cores and state_partitions(spark, 100 * ROWS_OF_STATE + 1) == 101


def test_parts_and_models_are_filled_at_a_time(spark, tmp_path, monkeypatch):
    """Each part waits until all have begun, so one after another they would never end; a model is still built once, and a failure is told."""
    together, began = threading.Barrier(3, timeout=30), []

    def fill(spark, folder, path, log):
        began.append(path)
        together.wait()
        log.record("extract", path.rpartition("/")[2], Run(T0, T1))

    monkeypatch.setattr(operations, "PARTS", dict.fromkeys(("a", "b", "c"), fill))
    assert operations.logs(spark, str(tmp_path)).all().count() == 3
    assert operations.logs(spark, str(tmp_path)).all().count() == 3 and len(began) == 3
    with pytest.raises(ZeroDivisionError):
        operations.at_once(spark, lambda n: 1 // n, (1, 0))
    assert operations.at_once(spark, lambda n: spark.range(n).count(), (3, 1, 2)) == [3, 1, 2]
