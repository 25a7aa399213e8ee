"""Tables of a relational database: their keys from its catalog, and reads that are cut by the key.

Any database that Spark has a JDBC driver for. Keys are looked up once for all tables; a table without one is cut by
the column that dates its rows.

Executors are processes of their own, so a database inside the driver's process is out of their reach. Where no server
is at hand, ``write_shards`` makes a database of several files in the folder that all share: a task fills each of them,
and afterwards every process can open each one for reading.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.csv as pc
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that stands in where a table has no key.
FALLBACK = "updated_at"
CATALOG = "table_name string, column_name string, position int"


@contextmanager
def connection(spark: SparkSession, url: str) -> Iterator:
    """The driver's own connection, for the catalog and for statements that aren't queries."""
    own = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        yield own
    finally:
        own.close()


def execute(spark: SparkSession, url: str, *statements: str) -> None:
    with connection(spark, url) as own:
        for statement in statements:
            made = own.createStatement()
            try:
                made.executeUpdate(statement)
            finally:
                made.close()


def catalog(spark: SparkSession, url: str, tables: list[str]) -> DataFrame:
    """(table_name, column_name, position): the primary keys' columns, a row for each column of the tables asked for.

    Names are matched without regard to case, as unquoted ones are stored in upper case or in lower case.
    """
    rows = []
    with connection(spark, url) as own:
        about = own.getMetaData()
        found = about.getTables(None, None, "%", None)
        named: dict[str, list[tuple]] = {}
        while found.next():
            named.setdefault(found.getString("TABLE_NAME").lower(), []).append((found.getString("TABLE_SCHEM"), found.getString("TABLE_NAME")))
        for table in tables:
            for schema, name in named.get(table.lower(), []):
                keys = about.getPrimaryKeys(None, schema, name)
                while keys.next():
                    rows.append((table, keys.getString("COLUMN_NAME"), int(keys.getShort("KEY_SEQ"))))
    return spark.createDataFrame(rows, CATALOG)


def keys_of(tables: DataFrame, keys: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """(table_name, key) of tables (table_name): the first column of each one's key in a catalog, or the fallback."""
    first = keys.groupBy("table_name").agg(F.min_by("column_name", "position").alias("found"))
    return tables.select("table_name").distinct().join(first, "table_name", "left").select("table_name", F.coalesce("found", F.lit(fallback)).alias("key"))


def key_registry(spark: SparkSession, url: str, tables: list[str], fallback: str = FALLBACK) -> dict[str, str]:
    """Each table's key: a row for each table that was asked for."""
    asked = spark.createDataFrame([(t,) for t in tables], "table_name string")
    return {r["table_name"]: r["key"] for r in keys_of(asked, catalog(spark, url, tables), fallback).collect()}


def read_by_key(spark: SparkSession, url: str, table: str, key: str, partitions: int = 8, rows_at_once: int = 10_000) -> DataFrame:
    """A table, read by ``partitions`` queries that cut it at even steps of its key (numbers, dates, instants).

    The bounds come from one query of the database. They cut only and leave out nothing: the first part has smaller and
    NULL keys too, the last all greater ones. Filters and columns that are asked for later reach every query.
    """
    plain = spark.read.format("jdbc").options(url=url, fetchsize=rows_at_once)
    bounds = plain.option("query", f'SELECT MIN("{key}") AS "low", MAX("{key}") AS "high" FROM {table}').load().collect()[0]
    reader = spark.read.format("jdbc").options(url=url, fetchsize=rows_at_once, dbtable=table)
    if bounds["low"] is None or bounds["low"] == bounds["high"]:
        return reader.load()
    return reader.options(partitionColumn=key, lowerBound=str(bounds["low"]), upperBound=str(bounds["high"]), numPartitions=partitions).load()


def write_table(rows: DataFrame, url: str, table: str, connections: int = 4) -> None:
    """Append rows to a table that is there."""
    rows.coalesce(connections).write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=5000).save()


def _fill(at: Path, ddl: str, table: str, batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> int:
    """A new database in ``at`` with one table of these rows, closed again; how many rows there were."""
    rows, options = 0, pc.WriteOptions(include_header=False, quoting_style="all_valid")
    with pc.CSVWriter(at / "rows.csv", schema, write_options=options) as out:
        for batch in batches:
            out.write_batch(batch)
            rows += len(batch)
    load = f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table.upper()}', 'rows.csv', ',', '\"', 'UTF-8', 0);\n" if rows else ""
    (at / "load.sql").write_text(f"CONNECT 'jdbc:derby:shop;create=true';\n{ddl};\n{load}CONNECT 'jdbc:derby:shop;shutdown=true';\n")
    java = f"{os.environ['JAVA_HOME']}/bin/java" if os.environ.get("JAVA_HOME") else "java"
    home = os.environ.get("SPARK_HOME") or pyspark.__path__[0]
    said = subprocess.run([java, "-Xmx256m", "-cp", f"{home}/jars/*", "org.apache.derby.tools.ij", "load.sql"], cwd=at, capture_output=True, text=True, check=True).stdout
    if wrong := [x for x in said.splitlines() if x.startswith(("ERROR", "JAVA ERROR")) and "08006" not in x]:  # 08006: it was closed
        raise RuntimeError("; ".join(wrong))
    return rows


def write_shards(rows: DataFrame, path: str, table: str, ddl: str, shards: int) -> list[str]:
    """Rows as a table of a database in shards, dealt by their first column; the shards' addresses.

    A shard is a database in a file, filled by one task in a process of its own and read-only from then on, so that
    any number of processes open it. ``path`` is a folder that is mounted everywhere. A repeated task leaves a file that nobody names.
    """
    folder, columns = unquote(urlparse(path).path), rows.columns
    plain = rows.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if kind.startswith("timestamp") else F.col(c).cast("string").alias(c) for c, kind in rows.dtypes))
    schema = pa.schema([(c, pa.string()) for c in columns])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Path(tempfile.mkdtemp())
        try:
            n = _fill(at, ddl, table, (b.cast(schema) for b in batches), schema)
            name = f"{folder}/{table}-{uuid.uuid4().hex}.jar"
            os.makedirs(folder, exist_ok=True)
            with zipfile.ZipFile(f"{name}.tmp", "w", zipfile.ZIP_STORED) as out:  # not compressed, so that pages are found by skipping
                for file in sorted((at / "shop").rglob("*")):
                    out.write(file, file.relative_to(at))
            os.replace(f"{name}.tmp", name)
        finally:
            shutil.rmtree(at, ignore_errors=True)
        yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    made = plain.repartition(shards, columns[0]).mapInArrow(fill, "file string, n long").collect()  # a row a shard
    return [f"jdbc:derby:jar:({r.file})shop" for r in sorted(made)]


def read_shards(spark: SparkSession, urls: list[str], table: str, key: str, partitions: int = 1) -> DataFrame:
    """A table of a database in shards: each shard read by its key."""
    return reduce(DataFrame.unionByName, (read_by_key(spark, url, table, key, partitions) for url in urls))
