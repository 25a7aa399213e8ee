"""Data tests that are declared as data, and run together.

A model's tests of single rows (``not_null``, ``accepted_values``) are one aggregate over it, each ``unique`` column
adds one shuffle of that column, each ``relationships`` one anti-join of keys. What fails is a number here, and can be
kept as rows (``failing``, ``keep_failures``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Models = Callable[[str], DataFrame]


@dataclass(frozen=True)
class DataTest:
    """``kind``: unique, not_null, accepted_values (``values``) or relationships (``to``: model and column)."""

    model: str
    column: str
    kind: str
    values: tuple = ()
    to: tuple[str, str] | None = None


def declare(model: str, columns: dict[str, list]) -> list[DataTest]:
    """Tests of a model: names of plain ones, lists of values, or (model, column) that a column refers to."""
    found = []
    for column, tests in columns.items():
        for test in tests:
            if isinstance(test, str):
                found.append(DataTest(model, column, test))
            elif isinstance(test, tuple):
                found.append(DataTest(model, column, "relationships", to=test))
            else:
                found.append(DataTest(model, column, "accepted_values", values=tuple(test)))
    return found


def _breaks(test: DataTest) -> Column:
    """Whether one row breaks a test of single rows; NULL is no value, so it breaks only ``not_null``."""
    column = F.col(test.column)
    return column.isNull() if test.kind == "not_null" else F.coalesce(~column.isin(*test.values), F.lit(False))


def failing(models: Models, test: DataTest) -> DataFrame:
    """The rows that break a test: of ``unique`` the values that repeat with their number, else rows of the model."""
    rows = models(test.model)
    if test.kind == "unique":
        return rows.where(F.col(test.column).isNotNull()).groupBy(test.column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if test.kind == "relationships":
        keys = models(test.to[0]).select(F.col(test.to[1]).alias(test.column)).distinct()
        return rows.where(F.col(test.column).isNotNull()).join(keys, test.column, "left_anti").select(*rows.columns)
    return rows.where(_breaks(test))


def _repeated(models: Models, test: DataTest) -> DataFrame:
    return failing(models, test).agg(F.count(F.lit(1)).alias("failures"))


def _orphans(models: Models, test: DataTest) -> DataFrame:
    """How many rows ``failing`` has: keys are counted where they lie before they travel to those that they refer to."""
    own = models(test.model).where(F.col(test.column).isNotNull()).groupBy(F.col(test.column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    keys = models(test.to[0]).select(F.col(test.to[1]).alias("key")).distinct().withColumn("there", F.lit(True))
    # An anti-join would be moved below the counts.
    return own.join(keys, "key", "left").where("there IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures"))


def report(models: Models, tests: Iterable[DataTest]) -> DataFrame:
    """(model, column, test, failures) of all tests; of ``unique`` the number of values that repeat, else of rows."""
    tests = list(dict.fromkeys(tests))
    parts = []
    for model in dict.fromkeys(t.model for t in tests):
        of_rows = [t for t in tests if t.model == model and t.kind in ("not_null", "accepted_values")]
        if of_rows:
            sums = models(model).agg(*(F.count_if(_breaks(t)).alias(f"n{i}") for i, t in enumerate(of_rows)))
            rows = (F.struct(F.lit(t.model).alias("model"), F.lit(t.column).alias("column"), F.lit(t.kind).alias("test"), F.col(f"n{i}").alias("failures")) for i, t in enumerate(of_rows))
            parts.append(sums.select(F.inline(F.array(*rows))))
    for t in tests:
        if t.kind in ("unique", "relationships"):
            n = _repeated(models, t) if t.kind == "unique" else _orphans(models, t)
            parts.append(n.select(F.lit(t.model).alias("model"), F.lit(t.column).alias("column"), F.lit(t.kind).alias("test"), "failures"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def keep_failures(models: Models, tests: Iterable[DataTest], path: str) -> dict[DataTest, int]:
    """Run tests and write what fails, as JSON, to a folder of each failing test; those that pass leave nothing."""
    tests = list(tests)
    counts = {(r.model, r.column, r.test): r.failures for r in report(models, tests).collect()}  # a row a test
    found = {}
    for t in tests:
        if n := counts[t.model, t.column, t.kind]:
            rows = failing(models, t)
            rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row")).write.mode("overwrite").parquet(f"{path}/{t.model}/{t.column}-{t.kind}")
            found[t] = n
    return found
