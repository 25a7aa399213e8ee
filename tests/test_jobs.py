"""The command line, from a database and a topic to the warehouse."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from souk.__main__ import instant, main
from souk.sources import database
from souk.sources.messages import send
from souk.sources.runlog import RunLog
from souk.streaming import live

T = datetime(2026, 1, 1)


def test_extract_and_load(spark, tmp_path, capsys):
    url = f"jdbc:derby:memory:j{uuid.uuid4().hex[:8]}"
    columns = '"category_id" INT NOT NULL PRIMARY KEY, "name" VARCHAR(20), "slug" VARCHAR(20), "parent_category_id" INT, "created_at" TIMESTAMP, "updated_at" TIMESTAMP'
    database.execute(spark, f"{url};create=true", f"CREATE TABLE categories ({columns})")
    rows = [(i, f"n{i}", "s", None, T, T + timedelta(days=i)) for i in range(1, 6)]
    database.write_table(spark.createDataFrame(rows, "category_id int, name string, slug string, parent_category_id int, created_at timestamp, updated_at timestamp"), url, "categories")
    database.execute(spark, url, 'UPDATE categories SET "name" = NULL WHERE "category_id" = 3')
    lake, log = f"{tmp_path}/lake", RunLog(spark, f"{tmp_path}/runs")

    def run(*more):
        assert main(["extract", "--url", url, "--out", lake, "--log", f"{tmp_path}/runs", "--tables", "categories", *more], spark) == 0
        return capsys.readouterr().out

    assert run("--incremental", "--end", "2026-01-04", "--dry-run").startswith("categories: 3 rows from 2025-12-05") and log.all().count() == 0
    assert "3 rows" in run("--incremental", "--end", "2026-01-04T00:00:00Z")
    assert "2 rows from 2026-01-04" in run("--incremental", "--end", "2026-01-07")
    assert "0 rows" in run("--incremental", "--end", "2026-01-08") and log.watermark("extract", "categories") == datetime(2026, 1, 8)
    assert "1 rows from 2026-01-05 12:00" in run("--start", "2026-01-06T00:00:00+00:00", "--lookback-minutes", "720", "--end", "2026-01-09", "--run-id", "again")
    load = ["load", "--lake", lake, "--warehouse", f"{tmp_path}/wh", "--quarantine", f"{tmp_path}/bad", "--truncate", "--tables"]
    assert main([*load, "categories,users"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["categories: 5 rows loaded, 1 in quarantine", "users: no objects in the lake"]
    with pytest.raises(SystemExit, match="unknown tables: nothing"):
        main([*load, "nothing"], spark)


def test_consume_and_clean(spark, tmp_path, capsys):
    good = F.format_string('{"event_id": "e%d", "user_id": 4, "event_type": "purchase", "session_id": "s", "event_time": "2026-10-02T10:30:00Z"}', F.col("id"))
    rows = spark.range(0, 30, 1, 1).select(F.when(F.col("id") == 7, "{").otherwise(good).alias("value"), F.lit(datetime(2026, 10, 2, 10, 31)).alias("timestamp"))
    send(rows, "clicks", f"{tmp_path}/log")
    run = ["consume", "--where", f"{tmp_path}/log", "--topic", "clicks", "--out", f"{tmp_path}/lake", "--checkpoint", f"{tmp_path}/c", "--from-beginning", "--batch-size", "10", "--log", f"{tmp_path}/runs"]
    assert main([*run, "--max-messages", "20"], spark) == 0 and main(run, spark) == 0
    assert capsys.readouterr().out.splitlines() == ["20 records, 1 malformed, 2 batches, 3 folders", "10 records, 0 malformed, 1 batches, 1 folders"]
    clean = ["clean", "--raw", f"{tmp_path}/lake/events", "--out", f"{tmp_path}/clean", "--now", "2026-10-02T12:00:00", "--log", f"{tmp_path}/runs"]
    assert main([*clean, "--lookback-hours", "3"], spark) == 0
    assert capsys.readouterr().out.startswith("29 rows in, 29 out, 0 duplicates, 1 partitions")
    assert {(r.component, r.metrics.get("output_rows")) for r in RunLog(spark, f"{tmp_path}/runs").all().collect()} == {("stream", None), ("clean", 29.0)}
    with pytest.raises(ValueError, match="loses events"):
        main([*clean, "--lookback-hours", "1"], spark)


def test_instants(spark):
    assert instant("2026-01-01T07:00:00+07:00") == instant("2026-01-01T00:00:00Z") == instant("2026-01-01") == T
    texts = ["2026-10-02T10:30:00Z", "2026-10-02 10:30:00", "soon", None]
    rows = spark.createDataFrame([(str(i), t, "purchase", "1", "s", "c", None, "ios", T) for i, t in enumerate(texts)], "event_id string, event_time string, event_type string, user_id string, session_id string, city string, device_type string, device string, consumed_at timestamp")
    got = [r.event_time for r in live.live_rows(rows, F.lit(T)).orderBy("event_id").collect()]
    assert got == [datetime(2026, 10, 2, 10, 30)] * 2 + [T] * 2
