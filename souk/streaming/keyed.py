"""A view that a stream keeps up to date: rows by key, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from souk.operators.versions import latest_version
from souk.sources.lake import exists


class KeyedView:
    """The newest row of every key.

    Each batch's changed rows are a folder under its number, so a batch that is replayed replaces itself and changes
    nothing. ``read`` takes each key's row of the greatest number; ``compact`` folds batches into a base of that
    number, which is complete before the batches go. Readers see one base and the batches after it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path, keys, schema

    def _numbers(self, kind: str) -> list[int]:
        if not exists(self.spark, f"{self.path}/{kind}"):
            return []
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        store = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getName().partition("=")[2]) for x in store.listStatus(at) if exists(self.spark, f"{x.getPath()}/_SUCCESS"))

    def _remove(self, kind: str, number: int) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/number={number}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def upsert(self, rows: DataFrame, number: int) -> None:
        base = self._numbers("base")
        if base and number <= base[-1]:
            return  # a replay of a batch that is folded in already
        rows.write.mode("overwrite").parquet(f"{self.path}/batches/number={number}")

    def read(self) -> DataFrame:
        base = self._numbers("base")[-1:]
        folders = [f"{self.path}/base/number={n}" for n in base]
        folders += [f"{self.path}/batches/number={n}" for n in self._numbers("batches") if not base or n > base[0]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f).withColumn("_number", F.lit(i)) for i, f in enumerate(folders)]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return latest_version(found, self.keys, "_number").drop("_number")

    def compact(self) -> None:
        numbers, base = self._numbers("batches"), self._numbers("base")
        if not numbers or base and numbers[-1] <= base[-1]:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/base/number={numbers[-1]}")
        for n in numbers:
            self._remove("batches", n)
        for n in base:
            self._remove("base", n)


@contextmanager
def shuffled_to(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """The session's shuffle partitions, changed for a moment."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        if partitions:
            spark.conf.set(name, partitions)
        yield
    finally:
        spark.conf.set(name, before)


#: Messages of a bounded stream that one partition of its state is given, over all batches.
ROWS_OF_STATE = 250_000


def state_partitions(spark: SparkSession, messages: int) -> int:
    """Into how many partitions the state of a stream of so many messages goes.

    Every batch reads and writes files of each partition, however few rows it has, so there are as many as cores until the
    messages ask for more.
    """
    return max(spark.sparkContext.defaultParallelism, -(-messages // ROWS_OF_STATE))


def keep(view: KeyedView, changes: DataFrame, checkpoint: str, trigger: dict | None = None, compact_every: int = 20, partitions: int | None = None) -> StreamingQuery:
    """Upsert a stream's updated rows (an aggregate in update mode: the rows of the keys that a batch touched) into a view.

    ``partitions`` of state are fixed by a checkpoint's first batch (without it: the session's shuffle partitions).
    """

    def write(batch: DataFrame, number: int) -> None:
        view.upsert(batch, number)
        if (number + 1) % compact_every == 0:
            view.compact()

    writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    with shuffled_to(view.spark, partitions):  # a query has the settings that its session had when it was started
        return writer.start()
