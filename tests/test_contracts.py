"""Loads by contract: footers, widened and cast columns, refused files and rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from souk.sources import contracts
from souk.sources.contracts import Contract, Loaded, footers, load_all, load_table

OWN = {c.table: c for c in (Contract("t", "id long NOT NULL, name string, amount decimal(8,2) NOT NULL, n int"), Contract("u", "id long NOT NULL"), Contract("v", "id long NOT NULL"))}


def test_every_kind_of_drift(spark, tmp_path):
    lake, warehouse, bad = f"{tmp_path}/lake", f"{tmp_path}/warehouse", f"{tmp_path}/bad"
    as_told = spark.createDataFrame([(1, "a", "1.50", 1), (2, None, "2.00", None)], "id long, name string, amount string, n int").withColumn("amount", F.col("amount").cast("decimal(8,2)"))
    as_told.write.parquet(f"{lake}/t/run=1")
    as_told.selectExpr("cast(id + 10 as int) id", "amount", "'more' AS extra", "cast(n as smallint) n").write.parquet(f"{lake}/t/run=2")  # narrower, reordered, one more, one less
    texts = [("21", "3.25", "7"), ("x", "1", "1"), ("22", None, "1"), ("23", "1.555", "1"), ("24", "9999999.00", "1"), ("25", "4", "3000000000"), (None, "1", "1")]
    spark.createDataFrame(texts, "id string, amount string, n string").write.parquet(f"{lake}/t/run=3")
    as_told.drop("amount").write.parquet(f"{lake}/t/run=4")
    (tmp_path / "lake/t/run=4/broken.parquet").write_bytes(b"PAR1 no footer")
    spark.createDataFrame([(1,)], "id long").write.parquet(f"{lake}/u/run=1")
    n_refused = len(list((tmp_path / "lake/t/run=4").glob("*.parquet")))
    for again in (False, True):
        done = load_all(spark, lake, warehouse, bad, OWN, truncate=again, contracts=OWN)
        assert done == [Loaded("t", 5, 6), Loaded("u", 1, 0), Loaded("v", 0, 0, "no objects in the lake")]
    rows = spark.read.parquet(f"{warehouse}/t")
    assert rows.dtypes == [("id", "bigint"), ("name", "string"), ("amount", "decimal(8,2)"), ("n", "int")]
    assert sorted((r.id, r.name, str(r.amount), r.n) for r in rows.collect()) == [(1, "a", "1.50", 1), (2, None, "2.00", None), (11, None, "1.50", 1), (12, None, "2.00", None), (21, None, "3.25", 7)]
    kept = {(json.loads(r.raw).get("id"), r.reason) for r in spark.read.parquet(f"{bad}/t/rows").collect()}
    assert kept == {("x", "id is no bigint"), ("22", "amount is missing"), ("23", "amount is no decimal(8,2)"), ("24", "amount is no decimal(8,2)"), ("25", "n is no int"), (None, "id is missing")}
    files = [(r.file.rpartition("/")[2], r.reason) for r in spark.read.parquet(f"{bad}/t/files").collect()]
    assert len(set(files)) == n_refused and {r for _, r in files} == {"no column amount", "no readable footer"}
    assert load_table(spark, OWN["u"], f"{lake}/u", f"{warehouse}/u", bad).rows == 1 and spark.read.parquet(f"{warehouse}/u").count() == 2
    with pytest.raises(ValueError, match="no contract for w"):
        load_all(spark, lake, warehouse, bad, ("t", "w"), contracts=OWN)


def test_footers_and_contracts(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i,)], "a long" if i else "a int").coalesce(1).write.parquet(f"{tmp_path}/{i}")
    files = [str(x.as_uri()) for x in sorted(tmp_path.rglob("*.parquet"))]
    assert sorted(len(x) for x in footers(spark, files).values()) == [1, 2]
    assert len(contracts.CONTRACTS) == 7 and all(not c.schema[0].nullable for c in contracts.CONTRACTS.values())
