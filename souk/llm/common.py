"""What the training-data operators share: the shared work folder, numbering, words and hashes.

Intermediate tables are written to the folder that the cluster names in ``spark.checkpoint.dir``: the
lineage ends there, so a lost executor costs one stage and never the whole job, and shuffle files of
finished stages can be let go.
"""

from __future__ import annotations

import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of this process (a single machine, as in tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(Path(tempfile.mkdtemp(prefix="souk-")).as_uri())
        import atexit

        atexit.register(shutil.rmtree, _own_folder[0].removeprefix("file://"), ignore_errors=True)
    return _own_folder[0]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of so many rows at most, else both sides hold 10,000 of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker, which Spark keeps for later tasks, gives its free memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


class Work:
    """A folder of its own in the shared folder for the tables and files of one call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.uri = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        small_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it again; what computed it is forgotten."""
        schema = df.schema
        df.write.option("compression", "zstd").parquet(f"{self.uri}/{name}")
        self.release()
        return self.spark.read.schema(schema).parquet(f"{self.uri}/{name}")

    def release(self) -> None:
        """Let Spark delete the shuffle files of stages that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
            path.getFileSystem(conf).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder in the shared store, as Python on any machine opens it."""
    uri = re.sub(r"^file:/+", "/", uri)
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def number_rows(work: Work, df: DataFrame, keys: list[str], order: list[str], out: str, name: str) -> DataFrame:
    """Number rows from 0 without gaps within each value of ``keys`` (none: over all), in ``order``.

    No group is gathered in one task: rows are dealt by ranges of (keys, order), each range counts its
    rows of each key, and the running totals of those counts (a row per range and key at most) are added.
    ``keys`` hold no nulls and at most some ten thousand values.
    """
    cols = [*keys, *order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    table = work.save(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
    table = table.withColumn("_part", F.shiftright("_at", 33))
    counts = table.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if not keys:  # a row for each range
        counts = F.broadcast(counts)
    numbered = table.join(counts, [*keys, "_part"]).withColumn(out, F.col("_base") + F.col("_at") - F.col("_first"))
    return numbered.drop("_at", "_part", "_first", "_base")


def running_totals(work: Work, df: DataFrame, order: list[str], weight: str, out: str, name: str) -> DataFrame:
    """``out``: the sum of ``weight`` (long) over all rows before, in ``order``. Rows are dealt by ranges, as in number_rows."""
    schema = df.withColumn("_before", F.lit(0).cast("long")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = 0
        for batch in batches:
            own = batch.column(weight).to_numpy()
            total = np.cumsum(own)
            yield batch.append_column("_before", pa.array(carry + total - own))
            carry += int(total[-1]) if len(total) else 0

    table = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema)
    table = work.save(table.withColumn("_part", F.spark_partition_id()), name)
    totals = table.groupBy("_part").agg(F.sum(weight).alias("_total"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    return table.join(F.broadcast(totals), "_part").withColumn(out, F.col("_base") + F.col("_before")).drop("_part", "_base", "_before")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(odd_constants(size, seed * 1_000_003 + size)):
            total += words[j : j + n] * c
    return mix(total)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A word of at most this many bytes is hashed with all others at once.
_SHORT = 64
_BYTE_VALUES = odd_constants(256, 11)
_PLACE_VALUES = odd_constants(_SHORT, 23)
_CHUNK = 1 << 19


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[starts[i]:ends[i]], in order and not touching each other."""
    lens = ends - starts
    out = np.zeros(len(lens), np.uint64)
    long = lens > _SHORT
    few, at = lens[~long], starts[~long]
    if len(few):
        first = np.cumsum(few) - few
        place = np.arange(int(few.sum())) - np.repeat(first, few)
        with np.errstate(over="ignore"):
            values = _BYTE_VALUES[data[np.repeat(at, few) + place]] * _PLACE_VALUES[place]
            out[~long] = mix(np.add.reduceat(values, first) + few.astype(np.uint64))
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


@dataclass
class Chunk:
    """The words of some consecutive texts, hashed.

    Text i of the chunk is ``data[offsets[i]:offsets[i+1]]`` (UTF-8), row ``row + i`` of its batch; its words
    are those from ``first[i]`` to ``first[i+1]``, each with its hash and its place in ``data``.
    """

    row: int
    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def text_of_word(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, text) of every ``size`` consecutive words of one text."""
        owner = self.text_of_word()
        n = max(0, len(owner) - size + 1)
        at = np.flatnonzero(owner[:n] == owner[len(owner) - n :])
        return window_hashes(self.hashes, size, seed)[at], at, owner[at]


def string_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each value begins and the last ends; nulls are empty."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def word_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[bounds[bounds < len(data)]] = inside[bounds[bounds < len(data)]]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = bounds[bounds > 0] - 1
    stops[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def chunks(array: pa.Array, table: bytes | None = None, size: int = _CHUNK) -> Iterator[Chunk]:
    """All texts of a column in chunks of about ``size`` bytes. ``table``: bytes are translated by it first.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A text larger than a chunk is hashed piece by
    piece, cut at spaces.
    """
    data, offsets = string_buffer(array)
    row = 0
    while row < len(array):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        part, at = data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        if table is not None:
            part = np.frombuffer(part.tobytes().translate(table), np.uint8)
        found = []
        lo = 0
        while lo < len(part):
            hi = min(len(part), lo + 2 * size)
            while hi < len(part) and not SPACE[part[hi]]:
                hi += 1
            starts, ends = word_places(part[lo:hi], at[(at >= lo) & (at <= hi)] - lo)
            found.append((_hash_words(part[lo:hi], starts, ends), starts + lo, ends + lo))
            lo = hi
        hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        yield Chunk(row, part, at, hashes, starts, ends, np.searchsorted(starts, at))
        row = to


def sliced(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some rows, so that Python holds few of its values at once."""
    return (batch.slice(lo, rows) for lo in range(0, len(batch), rows))


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of up to ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, each as narrow as it can be; before them how long and how wide they are, and how they compress."""
    widths = [next(w for w in (1, 2, 4, 8) if int(c.max(initial=0)) < 1 << 8 * w) for c in columns]
    raw = b"".join(c.astype(f"<u{w}").tobytes() for c, w in zip(columns, widths, strict=True))
    return bytes([len(columns), *widths]) + np.array([len(c) for c in columns], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_numbers(packed: bytes) -> list[np.ndarray]:
    n = packed[0]
    widths, sizes = packed[1 : n + 1], np.frombuffer(packed, "<u8", n, n + 1).tolist()
    total, at, found = sum(w * s for w, s in zip(widths, sizes, strict=True)), 0, []
    raw = pa.decompress(packed[9 * n + 1 :], decompressed_size=total, codec="zstd", asbytes=True) if total else b""
    for w, size in zip(widths, sizes, strict=True):
        found.append(np.frombuffer(raw, f"<u{w}", size, at))
        at += w * size
    return found
