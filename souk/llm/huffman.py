"""Token ids in a compact binary form: canonical length-limited Huffman codes.

``write`` tokenises every document, counts all ids, and writes files of some million ids each in ascending
order of doc_id. A code depends on its length alone (canonical), so a file's table is one byte an id, and no
code is longer than LIMIT bits, so one look-up in a table of 2**LIMIT entries decodes any code. The bit
stream is cut into blocks of BLOCK ids; a checkpoint gives the bit at which each block starts, so blocks are
decoded independently, here many at once.

A file, all integers little-endian:

    8 bytes   "SOUKHUF1"
    uint32    ids in the vocabulary, ids a block;  uint64  ids, documents, bytes of the bit stream
    uint8     code length of every id of the vocabulary (0: does not occur)
    int64     doc_id of every document, then uint8 whether it is null
    uint64    ids of every document
    uint64    first bit of every block
    bytes     the bit stream, most significant bit first
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import Work, batches_of, filesystem, lean, sliced
from souk.llm.tokens import encoder, forget, vocabulary_file

MAGIC = b"SOUKHUF1"
LIMIT = 18
BLOCK = 512
#: Blocks that are coded, or decoded, together.
AT_ONCE, READ_AT_ONCE = 128, 4096
#: Ids a file, after which a document begins a new one.
SEGMENT = 2_000_000
_head = struct.Struct("<8sIIQQQ")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        level = both[at]
        leaves.append(at < len(weights))
    take = 2 * len(weights) - 2
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id), each the next after the one before."""
    codes = np.zeros(len(lengths), np.uint32)
    code = previous = 0
    used = np.flatnonzero(lengths)
    for i in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[i]) - previous
        codes[i], previous = code, int(lengths[i])
        code += 1
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bit stream, and the first bit of every block.

    AT_ONCE blocks are coded together; each such stretch begins on a whole byte.
    """
    parts, checkpoints, done = [], [], 0
    for lo in range(0, len(ids), AT_ONCE * block):
        data, starts = _encode_stretch(ids[lo : lo + AT_ONCE * block], lengths, codes)
        parts.append(data)
        checkpoints.append(starts[::block] + 8 * done)
        done += len(data)
    return b"".join(parts), np.concatenate(checkpoints).astype(np.uint64) if checkpoints else np.zeros(0, np.uint64)


def _encode_stretch(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of some ids, filled up to a whole byte, and the first bit of each id."""
    widths = lengths[ids]
    ends = np.cumsum(widths, dtype=np.int64)
    starts = ends - widths
    words = np.zeros(int(ends[-1]) // 32 + 2, np.uint64)
    at = starts >> 5
    shifted = codes[ids].astype(np.uint64) << (64 - (starts & 31) - widths).astype(np.uint64)
    # Codes that start in one 32-bit word don't overlap, so their sum is their union.
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    words[at[heads]] = np.add.reduceat(shifted, heads)
    low = np.zeros(len(words), np.uint64)
    low[1:] = words[:-1] & np.uint64(0xFFFFFFFF)
    merged = ((words >> np.uint64(32)) | low).astype(">u4")
    return merged.tobytes()[: -(-int(ends[-1]) // 8)], starts


class Table:
    """The decoder's table: for every LIMIT bits (fewer if no code is as long) the id whose code they begin with, and its length."""

    def __init__(self, lengths: np.ndarray):
        self.limit = max(1, int(lengths.max(initial=0)))
        self.entries = np.zeros(1 << self.limit, np.uint32)  # id << 5 | length
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        own = lengths[order].astype(np.int64)
        filled = np.repeat((order << 5 | own).astype(np.uint32), 1 << (self.limit - own))
        self.entries[: len(filled)] = filled


def decode_bits(data: bytes, checkpoints: np.ndarray, n: int, table: Table, block: int = BLOCK) -> np.ndarray:
    """All ids: every step decodes the next id of each of READ_AT_ONCE blocks by one look-up."""
    limit, entries = table.limit, table.entries
    out = np.zeros((len(checkpoints), block), np.uint32)
    padded = np.frombuffer(data + bytes(16), np.uint8)
    windows = np.ndarray((len(data) + 8,), ">u8", buffer=padded, strides=(1,))  # 64 bits from each byte on
    mask, five = np.uint64((1 << limit) - 1), np.uint32(31)
    for lo in range(0, len(checkpoints), READ_AT_ONCE):
        at = checkpoints[lo : lo + READ_AT_ONCE].astype(np.int64)
        own, left = out[lo : lo + READ_AT_ONCE], n - lo * block
        for step in range(min(block, left)):
            if left - step <= (len(at) - 1) * block:
                at = at[:-1]  # the last block is shorter
            code = (windows[at >> 3].astype(np.uint64) >> (64 - limit - (at & 7)).astype(np.uint64)) & mask
            found = entries[code]
            own[: len(at), step] = found >> np.uint32(5)
            at = at + (found & five)
    return out.reshape(-1)[:n]


def write_file(out, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> None:
    data, checkpoints = encode_bits(ids, lengths, codes)
    out.write(_head.pack(MAGIC, len(lengths), BLOCK, len(ids), len(doc_ids), len(data)))
    for part in (lengths, np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], np.uint8), np.array(sizes, "<u8"), checkpoints.astype("<u8")):
        out.write(part.tobytes())
    out.write(data)


def read_file(source) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents' ids, their sizes, and all their token ids."""
    magic, n_vocabulary, block, n, n_docs, n_bytes = _head.unpack(source.read(_head.size))
    if magic != MAGIC:
        raise ValueError("not a file of this format")

    def array(kind: str, count: int) -> np.ndarray:
        return np.frombuffer(source.read(count * np.dtype(kind).itemsize), kind)

    lengths, doc_ids, null, sizes, checkpoints = array("u1", n_vocabulary), array("<i8", n_docs), array("u1", n_docs), array("<u8", n_docs), array("<u8", -(-n // block))
    return [None if x else d for d, x in zip(doc_ids.tolist(), null, strict=True)], sizes.astype(np.int64), decode_bits(source.read(n_bytes), checkpoints, n, Table(lengths), block)


_segment = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64()), ("counts", pa.binary())])


def _tokenise(docs: DataFrame, work: Work, path: str, end_id: int) -> DataFrame:
    """Raw ids of all documents in ascending order, some million a file; a row of what each file holds."""
    root = f"{work.uri}/raw"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(path).ids, np.array([end_id], "<u4").tobytes()
        store, folder = filesystem(root)
        store.create_dir(folder, recursive=True)
        part, segment = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> tuple:
            name = f"{part}-{segment}-{uuid.uuid4().hex}"  # a repeated attempt writes files of its own
            ids = np.frombuffer(b"".join(held), "<u4")
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(np.array([len(doc_ids)], "<i8").tobytes())
                out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes() + np.array([len(x) // 4 for x in held], "<i8").tobytes())
                out.write(np.array([2 if ids.max(initial=0) < 65536 else 4], "u1").tobytes())
                out.write(pa.compress(ids.astype("<u2" if ids.max(initial=0) < 65536 else "<u4").tobytes(), codec="zstd", asbytes=True))
            return part, segment, name, len(ids), zlib.compress(np.bincount(ids).astype("<i8").tobytes(), 1)

        for batch in batches:
            for doc_id, text in ((i, t) for part in sliced(batch) for i, t in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                doc_ids.append(doc_id)
                held.append(ids_of(text or "") + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT:
                    yield from batches_of([flush()], _segment)
                    doc_ids, held, size, segment = [], [], 0, segment + 1
        if held:
            yield from batches_of([flush()], _segment)

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("key", F.xxhash64("text")).repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").drop("key")
    return work.save(ordered.mapInArrow(lean(write), "part int, segment int, file string, n_ids long, counts binary"), "segments")


def _read_raw(store, path: str) -> tuple[list, list[int], np.ndarray]:
    with store.open_input_stream(path) as source:
        n = int(np.frombuffer(source.read(8), "<i8")[0])
        doc_ids, null, sizes = np.frombuffer(source.read(8 * n), "<i8"), np.frombuffer(source.read(n), "u1"), np.frombuffer(source.read(8 * n), "<i8")
        width, packed = source.read(1)[0], source.read()
    raw = pa.decompress(packed, decompressed_size=width * int(sizes.sum()), codec="zstd", asbytes=True)
    return [None if x else d for d, x in zip(doc_ids.tolist(), null, strict=True)], sizes.tolist(), np.frombuffer(raw, f"<u{width}")


def write(docs: DataFrame, path: str | None = None, end_id: int = 2) -> tuple[Work, DataFrame]:
    """Write all documents' ids; (part, segment, file, n_ids) of the files, which lie under ``work.uri``/tokens.

    Documents come by doc_id, null ones first, then by a hash of their texts; those that share both are equal and
    come in any order. A null text is empty. A very long text is one document of its file, which ends with it. No
    documents make no files.
    """
    work = Work(docs.sparkSession, "huffman")
    segments = _tokenise(docs, work, path or vocabulary_file(), end_id)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                own = np.frombuffer(zlib.decompress(packed), "<i8")
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    found = segments.select("counts").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)  # as long as the vocabulary at most
    counts[found["id"]] = found["n"]
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    raw, out = f"{work.uri}/raw", f"{work.uri}/tokens"
    schema = pa.schema([f for f in _segment if f.name != "counts"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # a worker that tokenised before needs that memory no more
        store, folder = filesystem(raw)
        target = filesystem(out)[1]
        store.create_dir(target, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['part']:06d}-{row['segment']:04d}-{uuid.uuid4().hex}.huf"
                with store.open_output_stream(f"{target}/{name}") as file:
                    write_file(file, *_read_raw(store, f"{folder}/{row['file']}"), lengths, codes)
                yield from batches_of([(row["part"], row["segment"], name, row["n_ids"])], schema)

    manifest = segments.drop("counts").repartition(_spread(segments), "file")
    files = work.save(manifest.mapInArrow(lean(encode), "part int, segment int, file string, n_ids long"), "files")
    work.drop("raw", "segments")
    return work, files


def _spread(rows: DataFrame) -> int:
    """Tasks for rows that stand for a file each: four files a task, once there are tasks for all cores."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // 4), min(n, 2 * cores))


def read(work: Work, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    of_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    of_part = of_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.join(of_part, "part").withColumn("first", F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    root = f"{work.uri}/tokens"
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, folder = filesystem(root)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{folder}/{row['file']}") as source:
                    doc_ids, sizes, ids = read_file(source)
                raw, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
                for doc_id, n in zip(doc_ids, sizes.tolist(), strict=True):
                    yield doc_id, row["first"] + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])
                    at += n

    return placed.select("file", "first").repartition(_spread(files), "file").mapInArrow(lean(lambda b: batches_of(decode(b), schema, 5000)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_huffman(spark, sf_dir: str) -> DataFrame:
    """A null text is an empty one (the end id alone); rows that repeat a doc_id stand one after another, null
    doc_ids first; a very long text is one document of any size; other columns are left aside; an empty table
    gives an empty result."""
    return read(*write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
