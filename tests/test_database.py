"""Keys from a database's catalog, and reads that are cut by them."""

from __future__ import annotations

import subprocess
import sys
import uuid
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from souk.sources import database

T = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def url(spark):
    own = f"jdbc:derby:memory:t{uuid.uuid4().hex[:8]}"
    database.execute(
        spark, f"{own};create=true",
        'CREATE TABLE plain ("id" BIGINT NOT NULL PRIMARY KEY, "v" VARCHAR(9))', 'CREATE TABLE pair ("x" INT NOT NULL, "b" INT NOT NULL, "a" INT NOT NULL, PRIMARY KEY ("b", "a"))',
        'CREATE TABLE loose ("n" INT, "updated_at" TIMESTAMP)', 'CREATE TABLE empty ("id" INT NOT NULL PRIMARY KEY)',
    )
    database.write_table(spark.createDataFrame([(i * i, f"v{i}") for i in range(100)], "id long, v string"), own, "plain")
    database.write_table(spark.createDataFrame([(i, T + timedelta(hours=i) if i else None) for i in range(50)], "n int, updated_at timestamp"), own, "loose")
    return own


def test_keys(spark, url):
    assert database.key_registry(spark, url, ["plain", "Pair", "loose", "none"]) == {"plain": "id", "Pair": "b", "loose": "updated_at", "none": "updated_at"}
    assert database.key_registry(spark, url, ["loose"], "n") == {"loose": "n"}
    keys = spark.createDataFrame([("t", "second", 2), ("t", "first", 1), ("u", "x", 1)], database.CATALOG)
    tables = spark.createDataFrame([("t",), ("v",), ("t",)], "table_name string")
    assert sorted(map(tuple, database.keys_of(tables, keys).collect())) == [("t", "first"), ("v", "updated_at")]


def test_reads_by_key(spark, url):
    rows = database.read_by_key(spark, url, "plain", "id", 5, 7)
    assert rows.rdd.getNumPartitions() == 5 and sorted(r.id for r in rows.collect()) == [i * i for i in range(100)]
    few = rows.where("id > 9000").select("v")
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,9000)]" in few._jdf.queryExecution().executedPlan().toString()
    assert few.count() == 5
    loose = database.read_by_key(spark, url, "loose", "updated_at", 4)
    assert loose.rdd.getNumPartitions() == 4 and sorted(r.n for r in loose.collect()) == list(range(50))  # a NULL key too
    assert database.read_by_key(spark, url, "empty", "id").count() == 0


_CLUSTER = """
import sys, tempfile
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(dir=sys.argv[1])).config("spark.executorEnv.PYTHONPATH", sys.argv[2]).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
rows = __spark_entry__.queries()["catalog_keys"](spark, sys.argv[3])
print(sorted(map(tuple, rows.groupBy("entity", "key").count().collect())))
"""


def test_executors_reach_the_database(tmp_path):
    """Executors that are processes of their own, as on a cluster."""
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", _CLUSTER, str(tmp_path), root, "/root/testdata/sf0.001"], cwd=root, capture_output=True, text=True, timeout=300, check=False)
    assert "[('orders', 'order_id', 1500), ('payments', 'updated_at', 1500)]" in done.stdout, done.stderr[-2000:]


def test_shards(spark, tmp_path):
    given = [(None, 1, None), ("", 2, T), ('a "b", c\n', 3, T + timedelta(microseconds=1)), ("ü", -4, T)]
    rows = spark.createDataFrame(given, "v string, id long, updated_at timestamp").select("id", "v", "updated_at")
    ddl = 'CREATE TABLE things ("id" BIGINT NOT NULL PRIMARY KEY, "v" VARCHAR(20), "updated_at" TIMESTAMP)'
    urls = database.write_shards(rows, tmp_path.as_uri(), "things", ddl, 3)
    assert len(urls) == 3 and database.key_registry(spark, urls[0], ["things"]) == {"things": "id"}
    assert sorted(map(tuple, database.read_shards(spark, urls, "things", "id", 2).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="23502|null"):
        database.write_shards(rows.withColumn("id", F.when(F.col("id") > 1, F.col("id"))), tmp_path.as_uri(), "things", ddl, 1)
