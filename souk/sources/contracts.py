"""What the warehouse takes from the lake: a contract of columns for each table, and what becomes of rows that break it.

Files are judged by their footers, which executors read, and files of one schema are loaded together. A column of a
narrower type is widened, one of another type is cast, one that isn't in the contract is left out, and a missing one
is NULL where it may be. Files without a column that must be there, and rows whose values can't be cast or are missing,
go to the quarantine with the reason; a table's other rows are loaded all the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from souk.sources.lake import objects


@dataclass(frozen=True)
class Contract:
    """A table's columns in order (a DDL string; NOT NULL: must be there and filled)."""

    table: str
    columns: str

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.columns)


@dataclass(frozen=True)
class Loaded:
    """How a table's load ended. ``skipped``: why nothing was to load."""

    table: str
    rows: int
    quarantined: int
    skipped: str | None = None


#: The raw tables of the shop.
CONTRACTS = {
    c.table: c
    for c in (
        Contract("users", "user_id long NOT NULL, email string NOT NULL, full_name string, phone string, city string, country string, created_at timestamp, updated_at timestamp NOT NULL"),
        Contract("sellers", "seller_id long NOT NULL, name string NOT NULL, email string, city string, country string, rating decimal(3,2), created_at timestamp, updated_at timestamp NOT NULL"),
        Contract("categories", "category_id int NOT NULL, name string NOT NULL, slug string, parent_category_id int, created_at timestamp, updated_at timestamp NOT NULL"),
        Contract("products", "product_id long NOT NULL, seller_id long NOT NULL, category_id int, name string, sku string, price decimal(14,2) NOT NULL, cost decimal(14,2), stock int, is_active boolean, created_at timestamp, updated_at timestamp NOT NULL"),
        Contract("orders", "order_id long NOT NULL, user_id long NOT NULL, status string NOT NULL, currency string, shipping_city string, total_amount decimal(14,2) NOT NULL, created_at timestamp, updated_at timestamp NOT NULL"),
        Contract("order_items", "order_item_id long NOT NULL, order_id long NOT NULL, product_id long NOT NULL, quantity int NOT NULL, unit_price decimal(14,2) NOT NULL, created_at timestamp, updated_at timestamp NOT NULL"),
        Contract("payments", "payment_id long NOT NULL, order_id long NOT NULL, method string, amount decimal(14,2) NOT NULL, status string NOT NULL, created_at timestamp, updated_at timestamp NOT NULL"),
    )
}


def footers(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Files by the schema in their footers (as JSON). Executors read them; a corrupt file has the schema ``""``."""
    schema = pa.schema([("file", pa.string()), ("schema", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(file if "://" in file or not file.startswith("file:") else "file://" + file.removeprefix("file:"))
                try:
                    rows.append(from_arrow_schema(pq.read_schema(path, filesystem=store)).json())
                except (pa.ArrowInvalid, OSError):
                    rows.append("")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], schema=schema)

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files) // 50, 200)))
    found = listed.mapInArrow(read, "file string, schema string").groupBy("schema").agg(F.collect_list("file").alias("files"))
    return {r["schema"]: sorted(r["files"]) for r in found.collect()}


def _as_contracted(rows: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns as ``row``, the row as it came (JSON) as ``raw``, and ``reason`` why it isn't taken."""
    columns, broken = [], []
    for field in contract.schema:
        given = F.col(f"`{field.name}`") if field.name in rows.columns else F.lit(None).cast(field.dataType)
        value: Column = given.try_cast(field.dataType)
        columns.append(value.alias(field.name))
        bad = given.isNotNull() & value.isNull()
        if isinstance(field.dataType, T.DecimalType):  # digits that would be rounded away
            bad = bad | F.coalesce(value.cast("decimal(38,10)") != given.try_cast("decimal(38,10)"), F.lit(False))
        broken.append(F.when(bad, f"{field.name} is no {field.dataType.simpleString()}"))
        if not field.nullable:
            broken.append(F.when(given.isNull(), f"{field.name} is missing"))
    return rows.select(F.struct(*columns).alias("row"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("raw"), F.coalesce(*broken).alias("reason"))


def _missing(contract: Contract, names: Iterable[str]) -> list[str]:
    return [f.name for f in contract.schema if not f.nullable and f.name not in set(names)]


def judge(spark: SparkSession, contract: Contract, files: list[str]) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """Rows of all files by schema (row, raw, reason), and files that are refused as a whole with the reason."""
    parts, refused = [], []
    for schema, names in footers(spark, files).items():
        if not schema:
            refused += [(f, "no readable footer") for f in names]
            continue
        given = T.StructType.fromJson(json.loads(schema))
        if missing := _missing(contract, given.names):
            refused += [(f, f"no column {', '.join(missing)}") for f in names]
        else:
            parts.append(_as_contracted(spark.read.schema(given).parquet(*names), contract))
    return parts, refused


def _merged(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def load_table(spark: SparkSession, contract: Contract, prefix: str, target: str, quarantine: str, truncate: bool = False) -> Loaded:
    """Load a table's objects under ``prefix`` into ``target``; what breaks the contract goes to ``quarantine``."""
    files = [x for x in objects(spark, prefix) if x.endswith(".parquet")]
    if not files:
        return Loaded(contract.table, 0, 0, "no objects in the lake")
    parts, refused = judge(spark, contract, files)
    n_rows = n_bad = 0
    if parts:
        rows, seen = _merged(parts), Observation()  # schemas are few, whatever the number of files
        taken = rows.observe(seen, F.count_if(F.col("reason").isNull()).alias("rows"), F.count_if(F.col("reason").isNotNull()).alias("bad"))
        taken.where("reason IS NULL").select("row.*").write.mode("overwrite" if truncate else "append").option("partitionOverwriteMode", "static").parquet(target)
        n_rows, n_bad = seen.get["rows"], seen.get["bad"]
        if n_bad:
            rows.where("reason IS NOT NULL").select("raw", "reason").write.mode("append").parquet(f"{quarantine}/{contract.table}/rows")
    if refused:
        spark.createDataFrame(refused, "file string, reason string").coalesce(1).write.mode("append").parquet(f"{quarantine}/{contract.table}/files")
    return Loaded(contract.table, n_rows, n_bad)


def load_all(spark: SparkSession, prefix: str, warehouse: str, quarantine: str, tables: Iterable[str] = tuple(CONTRACTS), truncate: bool = False, contracts: dict[str, Contract] = CONTRACTS) -> list[Loaded]:
    """All tables of a lake, each from its own prefix, in one run; a table that isn't there is skipped."""
    if unknown := set(tables) - set(contracts):
        raise ValueError(f"no contract for {', '.join(sorted(unknown))}")
    return [load_table(spark, contracts[t], f"{prefix}/{t}", f"{warehouse}/{t}", quarantine, truncate) for t in tables]
