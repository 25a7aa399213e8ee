"""The lines of orders: one stored table that the source's, the staged and the fact's lines are columns of."""

from __future__ import annotations

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from souk.operators.declared import DataTest, _orphans, failing
from souk.plans import models, operations, quality, registry, staging
from souk.plans.store import store_of
from souk.sources import marketplace as raw

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def odd(spark, tmp_path):
    """The small tables without some parts and orders: their lines are of nothing."""
    for table in ("customer", "nation", "region", "supplier", "events"):
        shutil.copy(f"{SMALL}/{table}.parquet", f"{tmp_path}/{table}.parquet")
    for table, kept in (("lineitem", "true"), ("part", "p_partkey % 5 <> 2"), ("orders", "o_orderkey % 7 <> 3")):
        spark.read.parquet(f"{SMALL}/{table}.parquet").where(kept).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def by_sql(folder: str, name: str) -> list:
    con = duckdb.connect()
    for table in ("customer", "nation", "region", "supplier", "events", "lineitem", "part", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{'/*.parquet' if table in ('lineitem', 'part', 'orders') else ''}'")
    return sorted(map(str, con.execute(registry.ORACLES[name]).fetchall()))


@pytest.mark.parametrize("name", ["stg_order_items", "fct_order_items"])
def test_lines_of_nothing_have_no_number(spark, odd, name):
    assert sorted(str(tuple(r)) for r in registry.QUERIES[name](spark, odd).collect()) == by_sql(odd, name)


def test_lines_are_stored_once(spark, odd):
    model, store = quality.stored_models(spark, odd), store_of(spark, odd)
    rows = {name: model(name) for name in ("stg_events", "stg_orders", "stg_order_items", "fct_order_items", "fct_events")}
    assert {"order_lines", "stg_orders", "stg_events"} <= set(store.known)
    assert not {"stg_order_items", "fct_order_items", "fct_events"} & set(store.known)
    assert sorted(rows["stg_order_items"].collect()) == sorted(staging.stg_order_items(spark, odd).collect())
    assert sorted(models.order_lines(spark, odd).select(*raw.ORDER_ITEM).collect()) == sorted(raw.order_items(spark, odd).collect())


def test_lines_travel_by_part_and_by_order_only(spark, odd):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = staging.stg_order_items(spark, odd)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 4  # lines twice, parts and orders once
    assert "l_shipdate" not in plan and "l_extendedprice" not in plan


def test_keys_are_counted_before_they_travel(spark):
    tables = {"a": spark.range(0, 4000, 1, 2).select(F.when(F.col("id") % 9 > 0, (F.col("id") / 1000).cast("long")).alias("k")), "b": spark.createDataFrame([(1,), (3,), (3,), (None,)], "id long")}
    test = DataTest("a", "k", "relationships", to=("b", "id"))
    n = _orphans(tables.__getitem__, test)
    assert n.collect()[0].failures == failing(tables.__getitem__, test).count() > 0
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.index("Join LeftOuter") < plan.index("count(1)")


def test_extract_reads_lines_that_are_stored_anyway(spark, odd):
    store = store_of(spark, odd)
    store.expect("order_lines")
    path = operations.operate(spark, odd, "extract")
    assert "order_lines" in store.known and "source_order_items" not in store.known and "source_orders" in store.known
    rows = spark.read.parquet(f"{path}/tables/order_items").select(*raw.ORDER_ITEM)
    assert sorted(rows.collect()) == sorted(raw.order_items(spark, odd).collect())
