"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together. Sorted by size, each goes to the shard with the least load, found by a
heap; a run of groups of one size is placed at once: the shards' next loads form arithmetic series, and the
run takes the least of their elements, exactly as one by one. So the driver handles different sizes, a row of
16 bytes each and never more than the bytes of the largest group, instead of groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Work, number_rows


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Of (size, number of groups): (size, rank, shard), where the groups of that size from this rank on go to that shard."""
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, n in sorted(sizes, reverse=True):
        if n <= 4 * shards:
            given = [0] * shards
            for _ in range(n):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                given[i] += 1
        else:
            loads = dict((i, load) for load, i in heap)
            given = _water(loads, size, n)
            heap = [(loads[i] + given[i] * size, i) for i in range(shards)]
            heapq.heapify(heap)
        rank = 0
        for i, k in enumerate(given):
            if k:
                out.append((size, rank, i))
                rank += k
    return out


def _water(loads: dict[int, int], size: int, n: int) -> list[int]:
    """How many of n equal groups each shard gets: nearly all by level, the last by the heap."""
    total = n * size
    open_shards = sorted(loads, key=loads.get)
    while loads[open_shards[-1]] * len(open_shards) > total + sum(loads[i] for i in open_shards):  # shards above the level get none
        open_shards.pop()
    level = (total + sum(loads[i] for i in open_shards)) // len(open_shards)
    given = [0] * len(loads)
    for i in open_shards:
        given[i] = max(0, (level - loads[i]) // size - 1)
    heap = [(loads[i] + given[i] * size, i) for i in loads]
    heapq.heapify(heap)
    for _ in range(n - sum(given)):
        load, i = heap[0]
        given[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    return given


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put every document into a shard (law ``bytes``: shards' bytes are nearly equal).

    A null text has no bytes; null texts are a group of their own, apart from empty ones. Rows that repeat a
    doc_id are rows of their own, a null doc_id stays null. Groups of one size are ranked by the hash of their
    text. A very long text is a size like any other; other columns are left aside. An empty table gives an
    empty result.
    """
    work = Work(docs.sparkSession, "sharding")
    text = F.col("text").cast("string")
    rows = work.save(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("")).alias("group"),
        ),
        "rows",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("of_group"))
    numbered = number_rows(work, groups, ["of_group"], ["group"], "rank", "groups")
    sizes = numbered.groupBy("of_group").agg(F.count(F.lit(1)).alias("n")).toArrow()
    runs = schedule(list(zip(*(c.to_pylist() for c in sizes.columns), strict=True)), shards)
    placed = _assign(numbered, runs)
    found = rows.join(placed, "group").drop("group")
    out = number_rows(work, found, ["shard"], ["doc_id", "text_crc32", "size"], "slot", "shards")
    work.drop("rows", "groups")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _assign(numbered: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
    """Each group's shard, by its size and its number among those of that size."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 3)
    sizes, first = np.unique(table[:, 0], return_index=True)
    last = np.append(first[1:], len(table))
    schema = pa.schema([("group", pa.string()), ("shard", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("of_group", "rank"))
            at = np.searchsorted(sizes, key)
            low, high = first[at], last[at]
            while (high - low > 1).any():  # the last run that starts at the rank or before it
                middle = (low + high) // 2
                fits = (table[np.minimum(middle, len(table) - 1), 1] <= rank) & (high - low > 1)
                low, high = np.where(fits, middle, low), np.where(fits | (high - low <= 1), high, middle)
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(table[low, 2].astype(np.int32))], schema=schema)

    return numbered.select("group", "of_group", "rank").mapInArrow(place, "group string, shard int")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
