"""Models that are kept: computed once from a folder's tables, stored, and read by everything built on them.

A store belongs to a session and to the exact files of a folder (names, sizes, times), so a changed table makes a
new one. It lies in the folder that all executors share.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from souk.session import scratch

Model = Callable[[SparkSession, str], DataFrame]
_stores: dict[tuple, Store] = {}
_opening = threading.Lock()


def _files(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        one = files.next()
        found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(found))


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.root = spark, scratch(spark, "models")
        self.known: dict[str, object] = {}
        self.expected: set[str] = set()
        self.building: dict[str, threading.RLock] = {}
        self.naming = threading.Lock()

    def _one(self, name: str) -> threading.RLock:
        """Who builds a model has it to himself; different ones are built at a time."""
        with self.naming:
            return self.building.setdefault(name, threading.RLock())

    def expect(self, name: str) -> None:
        """Say that a model will be stored in any case, so that who could read it needn't compute it another way."""
        self.expected.add(name)

    def has(self, name: str) -> bool:
        return name in self.known or name in self.expected

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored model, computed and written by the first who asks."""
        with self._one(name):
            if name not in self.known:
                rows = build()
                if name not in self.known:  # a model that stores itself is stored by now
                    rows.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
                    self.known[name] = rows.schema
        return self.spark.read.schema(self.known[name]).parquet(f"{self.root}/{name}")

    def folder(self, name: str, fill: Callable[[str], None]) -> str:
        """A folder that is filled by the first who asks; one that wasn't filled to its end is left aside for a new one."""
        with self._one(name):
            if name not in self.known:
                path = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
                fill(path)
                self.known[name] = path
        return self.known[name]


def store_of(spark: SparkSession, folder: str) -> Store:
    key = spark.sparkContext.applicationId, folder, _files(spark, folder)
    with _opening:
        if key not in _stores:
            _stores[key] = Store(spark, folder)
        return _stores[key]


def kept(build: Model) -> Model:
    """A model that is stored on its first use."""

    @wraps(build)
    def read(spark: SparkSession, folder: str) -> DataFrame:
        return store_of(spark, folder).table(build.__name__, lambda: build(spark, folder))

    return read
