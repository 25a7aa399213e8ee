"""Declared tests, differences of keys, and histories from logs of changes, against plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from souk.operators.declared import DataTest, declare, failing, keep_failures, report
from souk.operators.difference import differing_ranges, key_difference
from souk.operators.versions import scd2_apply, scd2_from_changes, scd2_merge_changes, scd2_versions
from souk.plans import quality

T = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def shop(spark):
    tables = {
        "orders": spark.createDataFrame([(1, "paid", 7), (1, "paid", 8), (2, "odd", 7), (3, None, None), (None, "odd", 9), (None, "new", 7)], "id long, status string, user long"),
        "users": spark.createDataFrame([(7,), (8,), (8,), (None,)], "id long"),
    }
    return tables.__getitem__


def test_declared(shop, tmp_path):
    tests = declare("orders", {"id": ["unique", "not_null"], "status": [["paid", "new"]], "user": [("users", "id")]}) + declare("users", {"id": ["unique", "not_null", [7, 8]]})
    got = {(r.model, r.column, r.test): r.failures for r in report(shop, [*tests, tests[0]]).collect()}
    assert got == {
        ("orders", "id", "unique"): 1, ("orders", "id", "not_null"): 2, ("orders", "status", "accepted_values"): 2, ("orders", "user", "relationships"): 1,
        ("users", "id", "unique"): 1, ("users", "id", "not_null"): 1, ("users", "id", "accepted_values"): 0,
    }
    assert [tuple(r) for r in failing(shop, tests[0]).collect()] == [(1, 2)]
    kept = keep_failures(shop, tests, f"{tmp_path}/failures")
    assert kept == {t: got[t.model, t.column, t.kind] for t in tests if got[t.model, t.column, t.kind]}
    spark = shop("users").sparkSession
    rows = [json.loads(r.row) for r in spark.read.parquet(f"{tmp_path}/failures/orders/status-accepted_values").collect()]
    assert sorted(rows, key=str) == sorted([{"id": 2, "status": "odd", "user": 7}, {"id": None, "status": "odd", "user": 9}], key=str)
    assert not (tmp_path / "failures/users/id-accepted_values").exists()


def test_declared_on_nothing(shop):
    empty = lambda name: shop(name).limit(0)
    tests = declare("orders", {"id": ["unique", "not_null"], "user": [("users", "id")]})
    assert {r.failures for r in report(empty, tests).collect()} == {0}


def test_what_is_declared():
    assert len(quality.TESTS) == len(set(quality.TESTS)) == 116
    assert Counter(t.kind for t in quality.TESTS)["relationships"] == 12
    assert all(t.to[0] in quality.DECLARED for t in quality.TESTS if t.to)
    assert DataTest("stg_orders", "order_status", "accepted_values", tuple(quality.STATUSES)) in quality.TESTS


def test_source_freshness(spark):
    rows = spark.createDataFrame([(T,), (T + timedelta(hours=5),)], "at timestamp")
    limits = {"a": ("at", 3.0, 12.0), "b": ("at", 1.0, 2.0), "c": ("at", 3.0, 12.0), "d": ("at", 9.0, 12.0)}
    got = {r.source: (r.age_hours, r.status) for r in quality.source_freshness({"a": rows, "b": rows, "c": rows.limit(0), "d": rows}, limits, T + timedelta(hours=8.5)).collect()}
    assert got == {"a": (3.5, "warn"), "b": (3.5, "error"), "c": (float("inf"), "error"), "d": (3.5, "ok")}


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_key_difference(spark, ranges):
    rng = random.Random(ranges)
    keys = [None, None, *(rng.randint(-1000, 1000) for _ in range(400)), 2**62, -(2**62)]
    other = [k for k in keys if rng.random() > 0.02] + [None, 5, 5, 3000]
    frames = [spark.createDataFrame([(k, "x") for k in x], "k long, other string") for x in (keys, other)]
    a, b = Counter(keys), Counter(other)
    want = sorted(((k, a[k], b[k]) for k in a.keys() | b.keys() if a[k] != b[k]), key=str)
    assert sorted(map(tuple, key_difference(*frames, "k", ranges).collect()), key=str) == want
    assert key_difference(frames[0], frames[0], "k", ranges).count() == 0
    assert key_difference(frames[0].limit(0), frames[0].limit(0), "k", ranges).count() == 0
    assert key_difference(frames[0], frames[0].limit(0), "k", ranges).count() == len(a)


def test_only_ranges_that_differ_are_read(spark, tmp_path):
    spark.range(0, 10_000).write.parquet(f"{tmp_path}/a")
    rows = spark.read.parquet(f"{tmp_path}/a")
    bounds, nulls = differing_ranges(rows, rows.where("id NOT IN (5000, 5001, 9999)"), "id", 100)
    assert bounds == [(5000, 5099), (9900, 9999)] and not nulls
    plan = key_difference(rows, rows.where("id <> 5000"), "id", 100)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,5000)" in plan and "LessThanOrEqual(id,5099)" in plan


def told(changes):
    """The versions of a log by plain Python: (key, value, from, to)."""
    out = []
    for key in {k for k, *_ in changes if k is not None}:
        last: dict = {}
        for _, at, seq, value, gone in sorted((c for c in changes if c[0] == key and c[1] is not None), key=lambda c: (c[1], c[2])):
            last[at] = (gone, None if gone else value)
        points = [(at, s) for i, (at, s) in enumerate(sorted(last.items())) if i == 0 or s != sorted(last.items())[i - 1][1]]
        out += [(key, s[1], at, points[i + 1][0] if i + 1 < len(points) else None) for i, (at, s) in enumerate(points) if not s[0]]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_histories_from_changes(spark, seed):
    rng = random.Random(seed)
    changes = [(rng.choice([None, 1, 2, 3]), T + timedelta(hours=rng.randint(0, 30)), i, rng.choice(["a", "b", None]), rng.random() < 0.2) for i in range(120)] + [(1, None, 999, "a", False)]
    schema = "k long, at timestamp, seq long, v string, gone boolean"
    whole = scd2_from_changes(spark.createDataFrame(changes, schema), "k", "at", ["v"], "seq", "gone")
    assert sorted(map(tuple, scd2_versions(whole, "k", ["v"]).collect()), key=str) == told(changes)
    order = list(changes)
    rng.shuffle(order)  # late ones, in four runs, the last of which comes twice
    parts = [spark.createDataFrame(order[i::4], schema) for i in range(4)]
    history = scd2_from_changes(parts[0], "k", "at", ["v"], "seq", "gone")
    for part in [*parts[1:], parts[3]]:
        history = scd2_merge_changes(history, part, "k", "at", ["v"], "seq", "gone")
    assert sorted(map(tuple, history.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert scd2_merge_changes(history, parts[0].limit(0), "k", "at", ["v"], "seq", "gone").count() == whole.count()


def test_what_snapshots_cannot_rebuild(spark):
    """A value between two snapshots is in the log's history only."""
    log = spark.createDataFrame([(1, T, 1, "a"), (1, T + timedelta(days=1), 2, "b"), (1, T + timedelta(days=2), 3, "c")], "k long, at timestamp, seq long, v string")
    first, second = (log.where(f"seq = {i}").select("k", "v", "at") for i in (1, 3))
    snapshots = scd2_apply(scd2_apply(None, first, "k", "at", T), second, "k", "at", T + timedelta(days=2))
    assert sorted(r.v for r in snapshots.collect()) == ["a", "c"]
    assert sorted(r.v for r in scd2_versions(scd2_from_changes(log, "k", "at", ["v"], "seq"), "k", ["v"]).collect()) == ["a", "b", "c"]
