"""How a model is kept: as a view, as a sorted table, or as a table that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.operators.versions import since, upsert


def view(rows: DataFrame, name: str) -> DataFrame:
    """A named view: nothing is stored, every reader computes what it reads."""
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.table(name)


def table(rows: DataFrame, path: str, sort_by: tuple[str, ...] = ()) -> DataFrame:
    """Rewritten as a whole, dealt and sorted by ``sort_by`` so that readers skip files and row groups."""
    if sort_by:
        rows = rows.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    schema = rows.schema
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def incremental(spark: SparkSession, rows: DataFrame, path: str, key: str, column: str, lookback: str) -> DataFrame:
    """Rows newer than the table's newest, less ``lookback``, replace those of their keys. The first run takes all.

    Every run is a folder of its own (a table can't be read and overwritten at once); the newest one counts.
    """
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(path)
    store = base.getFileSystem(conf)
    runs = sorted(int(x.getPath().getName()) for x in store.listStatus(base)) if store.exists(base) else []
    target = spark.read.schema(rows.schema).parquet(f"{path}/{runs[-1]}") if runs else None
    number = runs[-1] + 1 if runs else 0
    upsert(target, since(rows, target, column, F.expr(lookback)), key).write.parquet(f"{path}/{number}")
    for old in runs[:-1]:  # a reader may still be at the one before
        store.delete(hadoop.Path(f"{path}/{old}"), True)
    return spark.read.schema(rows.schema).parquet(f"{path}/{number}")
