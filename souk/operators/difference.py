"""Which rows a warehouse lacks, or has too many of: the exact difference of two multisets of keys.

Counts say that something is missing, not what. Both sides are first summed up by ranges of the key: a number of
rows and two sums of different 64-bit hashes of the keys for each range, so two ranges that differ look alike with a chance of
some 2**-128. Only ranges that differ are read again, and their bounds reach the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _range_of(key: str, low: int, width: int) -> Column:
    """Which range of ``width`` keys from ``low`` on; in decimals, as the keys' spread may pass 64 bits."""
    return F.coalesce(F.expr(f"(CAST(`{key}` AS DECIMAL(38,0)) - ({low})) DIV {width}"), F.lit(-1).cast("long"))


def fingerprints(rows: DataFrame, key: str, low: int, width: int) -> DataFrame:
    """(range, n, sum_1, sum_2) of each range of the key; NULL keys are the range -1. One row a range and task is shuffled."""
    hashes = (F.sum(F.xxhash64(key, F.lit(salt)).cast("decimal(38,0)")) for salt in (1, 2))
    return rows.groupBy(_range_of(key, low, width).alias("range")).agg(F.count(F.lit(1)).alias("n"), *(h.alias(f"sum_{i + 1}") for i, h in enumerate(hashes)))


def differing_ranges(source: DataFrame, warehouse: DataFrame, key: str, ranges: int = 4096) -> tuple[list[tuple[int, int]], bool]:
    """Bounds (low, high) of ranges that differ, neighbours merged, and whether NULL keys differ. ``ranges`` bounds what the driver gets."""
    bounds = [side.agg(F.min(key), F.max(key)).collect()[0] for side in (source, warehouse)]
    known = [x for pair in bounds for x in pair if x is not None]
    low, high = (min(known), max(known)) if known else (0, 0)
    width = (high - low) // ranges + 1
    one, two = (fingerprints(side, key, low, width) for side in (source, warehouse))
    same = reduce(lambda a, b: a & b, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("n", "sum_1", "sum_2")))
    both = one.alias("a").join(two.alias("b"), F.col("a.range") == F.col("b.range"), "full")
    found = sorted(r[0] for r in both.where(~F.coalesce(same, F.lit(False))).select(F.coalesce("a.range", "b.range")).collect())
    merged: list[tuple[int, int]] = []
    for r in found:
        if r < 0:
            continue
        at, to = low + r * width, min(low + (r + 1) * width - 1, high)
        if merged and merged[-1][1] == at - 1:
            merged[-1] = merged[-1][0], to
        else:
            merged.append((at, to))
    return merged, found[:1] == [-1]


def key_difference(source: DataFrame, warehouse: DataFrame, key: str, ranges: int = 4096) -> DataFrame:
    """(key, source_count, warehouse_count) of the keys that don't occur equally often on both sides, NULL too.

    ``key`` is a column of whole numbers of both. Rows of ranges that agree aren't read a second time.
    """
    bounds, nulls = differing_ranges(source, warehouse, key, ranges)
    wanted = reduce(lambda a, b: a | b, (F.col(key).between(lo, hi) for lo, hi in bounds), F.col(key).isNull() if nulls else F.lit(False))
    sides = [side.where(wanted).select(F.col(key).alias("key"), F.lit(s).alias("s"), F.lit(1 - s).alias("w")) for side, s in ((source, 1), (warehouse, 0))]
    counts = sides[0].union(sides[1]).groupBy("key").agg(F.sum("s").alias("source_count"), F.sum("w").alias("warehouse_count"))
    return counts.where("source_count <> warehouse_count")
