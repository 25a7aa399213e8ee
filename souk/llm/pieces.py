"""SentencePiece ids of whole texts by a table of distinct chunks, and their way back to text.

The library writes every space as a marker and puts one before the text. A model none of whose pieces reaches
over the place before a marker encodes a text chunk by chunk, a chunk being markers and what follows them.

1. Texts are cut into chunks, block by block: a block has a table of its distinct chunks, and its documents become
   the numbers of their chunks, in order of position, in a file in the shared folder.
2. The blocks' chunks are dealt in packets by the chunks' hashes: each distinct one is segmented once by the library.
   A chunk, however frequent, travels once a block.
3. Numbered ids return to their block, where documents are joined together by position.

A model that doesn't fit (pieces across markers, a normaliser that changes more than spaces) makes a whole text
one chunk, so results are right all the same.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Work, batches_of, filesystem, lean, pack_numbers, sliced, unpack_numbers
from souk.llm.tokens import vocabulary_file

MARKER = "▁"
#: A block ends with the document that takes it to so many chunks, or distinct chunks: it bounds what a task holds.
BLOCK_CHUNKS, BLOCK_DISTINCT = 6_000_000, 700_000
#: Bytes of text for each bucket of chunks: it bounds the table of a bucket's distinct chunks.
BUCKET_BYTES = 10_000_000
_cut = re.compile(" +[^ ]*").findall


class Segmenter:
    """A model's library object, and what chunks it allows."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        across = any(MARKER in p.lstrip(MARKER) for p in pieces)
        probe = " ﬁ A  \tb　 "
        self.by_chunk = not across and self.model.normalize(probe) == MARKER + probe.replace(" ", MARKER)
        self.lone = self.model.piece_to_id(MARKER)
        own = self.model
        #: Texts of pieces; of bytes, control pieces and the unknown one only the library knows them.
        self.texts = [None if not self.by_chunk or own.is_byte(i) or own.is_control(i) or own.is_unknown(i) else own.id_to_piece(i).replace(MARKER, " ") for i in range(own.get_piece_size())]

    def chunks(self, text: str) -> list[str]:
        """Chunks with spaces for markers; the first space is the one that the library puts before a text."""
        if not text:
            return []
        return _cut(" " + text.replace(MARKER, " ")) if self.by_chunk else [" " + text]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. A marker that nothing follows is a piece of its own; the library can't be asked for it, an empty text has no ids."""
        return [ids or [self.lone] for ids in self.model.encode([c[1:] for c in chunks], num_threads=1)]

    def text_of(self, ids: list[int]) -> str:
        """The text of a chunk, with the space that stands for its first marker."""
        try:
            return "".join([self.texts[i] for i in ids])
        except TypeError:
            return " " + self.model.decode(ids)


@cache
def segmenter(path: str) -> Segmenter:
    """One for all tasks of a Python worker."""
    return Segmenter(path)


class _Numbers(dict):
    """Numbers of chunks in the order of their first use."""

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number


_packet = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("file", pa.string()), ("packet", pa.binary())])


def _pack_chunks(no: np.ndarray, chunks: list[bytes]) -> bytes:
    """Chunks with their numbers, which ascend."""
    return pack_numbers(np.diff(no, prepend=0), np.fromiter(map(len, chunks), np.int64, len(chunks)), np.frombuffer(b"".join(chunks), np.uint8))


def _unpack_chunks(packed: bytes) -> tuple[np.ndarray, list[bytes]]:
    steps, sizes, data = unpack_numbers(packed)
    ends, raw = np.cumsum(sizes, dtype=np.int64).tolist(), data.tobytes()
    return np.cumsum(steps, dtype=np.int64), [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _write_block(out, doc_ids: list[int | None], sizes: list[int], codes: np.ndarray) -> None:
    """Documents of a block: ids, how many chunks each has, and the chunks' numbers, byte by byte apart so that they compress."""
    head = pack_numbers(np.array([x is None for x in doc_ids], np.int64), np.array([x or 0 for x in doc_ids], np.int64).view(np.uint64), np.array(sizes, np.int64))
    planes = [pack_numbers(codes >> np.uint32(8 * k) & np.uint32(255)) for k in range(4)]
    for part in (head, *planes):
        out.write(len(part).to_bytes(8, "little") + part)


def _read_block(source) -> tuple[list[int | None], list[int], np.ndarray]:
    head, *planes = (unpack_numbers(source.read(int.from_bytes(source.read(8), "little"))) for _ in range(5))
    codes = sum((p[0].astype(np.uint32) << np.uint32(8 * k) for k, p in enumerate(planes)), np.zeros(1, np.uint32))
    null, ids, sizes = head
    return [None if x else i for x, i in zip(null.tolist(), ids.astype(np.uint64).view(np.int64).tolist(), strict=True)], sizes.tolist(), codes


def _number_chunks(path: str, root: str, buckets: int):
    """Blocks: a file of each block's documents, with numbers for chunks, and its distinct chunks in packets, one for
    each bucket of the chunks' hashes. A packet of no bucket names the file; a repeated task writes files of its own."""
    most, most_distinct = BLOCK_CHUNKS, BLOCK_DISTINCT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cut = segmenter(path).chunks
        store, folder = filesystem(root)
        store.create_dir(folder, recursive=True)
        numbers, doc_ids, held, n = _Numbers(), [], [], 0

        def flush() -> Iterator[tuple]:
            codes = np.concatenate(held)
            order = np.argsort(-np.bincount(codes, minlength=len(numbers)), kind="stable")  # frequent chunks get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            chunks = [c.encode() for c in numbers]
            # Named by its documents: a repeated task that read them in another order makes another block, never a mixed one.
            block = xxhash.xxh3_64_intdigest(b"".join(chunks) + codes.tobytes() + repr(doc_ids).encode(), TaskContext.get().partitionId()) - (1 << 63)
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{folder}/{name}") as out:
                _write_block(out, doc_ids, list(map(len, held)), rank[codes])
            yield None, block, name, None
            bucket = np.fromiter((zlib.crc32(chunks[i]) for i in order.tolist()), np.int64, len(chunks)) % buckets
            of_bucket = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[of_bucket], prepend=-1)).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(of_bucket)], strict=False):
                no = of_bucket[lo:hi]
                yield int(bucket[no[0]]), block, None, _pack_chunks(no, [chunks[i] for i in order[no].tolist()])

        for batch in batches:
            for part in sliced(batch, 64):
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    doc_ids.append(doc_id)
                    held.append(np.frombuffer(array("I", map(numbers.__getitem__, cut(text or ""))), np.uint32))
                    n += len(held[-1])
                    if n >= most or len(numbers) >= most_distinct:
                        yield from flush()
                        numbers, doc_ids, held, n = _Numbers(), [], [], 0
        if doc_ids:
            yield from flush()

    return lean(lambda batches: batches_of(run(batches), _packet, 200))


def _segment_once(path: str):
    """Of packets sorted by bucket: each distinct chunk of a bucket is segmented once. Packets come back with ids for chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own, now, known = segmenter(path), None, {}
        for batch in batches:
            for part in sliced(batch, 64):
                for bucket, block, packet in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if bucket != now:
                        now, known = bucket, {}
                    no, chunks = _unpack_chunks(packet)
                    fresh = [c for c in chunks if c not in known]
                    if fresh:
                        ids = own.segment([c.decode() for c in fresh])
                        known.update(zip(fresh, (array("I", x).tobytes() for x in ids), strict=True))
                    found = [known[c] for c in chunks]
                    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
                    yield block, pack_numbers(np.diff(no, prepend=0), sizes, np.frombuffer(b"".join(found), np.uint32))

    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary())])
    return lean(lambda batches: batches_of(run(batches), schema, 200))


def _digest(ids: str, text: str) -> tuple:
    return hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _whole(ids: str, text: str) -> tuple:
    return [int(x) for x in ids.split(",")] if ids else [], text


def _join_back(path: str, root: str, finish, schema: pa.Schema):
    """Of rows sorted by block, its packets first: the block's documents, ids and texts joined by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = segmenter(path)
        decimal = list(map(str, range(own.model.get_piece_size())))
        store, folder = filesystem(root)
        block, ids, texts, sizes = None, {}, {}, {}
        for batch in batches:
            for part in sliced(batch, 64):
                for at, packet, file in zip(*(part.column(c).to_pylist() for c in ("block", "ids", "file")), strict=True):
                    if at != block:
                        block, ids, texts, sizes = at, {}, {}, {}
                    if packet is not None:
                        steps, counts, flat = unpack_numbers(packet)
                        flat, end = flat.tolist(), 0
                        for no, n in zip(np.cumsum(steps, dtype=np.int64).tolist(), counts.tolist(), strict=True):
                            some = flat[end : end + n]
                            end += n
                            ids[no], texts[no], sizes[no] = ",".join([decimal[i] for i in some]), own.text_of(some), n
                        continue
                    with store.open_input_stream(f"{folder}/{file}") as source:
                        doc_ids, lengths, all_codes = _read_block(source)
                    end = 0
                    for doc_id, length in zip(doc_ids, lengths, strict=True):
                        codes = all_codes[end : end + length].tolist()
                        end += length
                        yield doc_id, sum(map(sizes.__getitem__, codes)), *finish(",".join(map(ids.__getitem__, codes)), "".join(map(texts.__getitem__, codes))[1:])

    return lean(lambda batches: batches_of(run(batches), schema, 256))


def encode(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs``: its text's ids and the text that they decode to.

    With ``digests`` SHA-256 of both instead (ids_sha256 over decimal ids with commas between, decoded_sha256), so
    that whole texts needn't leave the task. A null text is empty, an empty one has no ids; rows are taken as they
    are, so repeated ones, or those without a doc_id, come out each; a very long text is one row of any size, and a
    block by itself; other columns are left aside; an empty table gives an empty one.
    """
    path = path or vocabulary_file("piece_bpe_32k.model")
    work = Work(docs.sparkSession, "pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    files = f"{work.uri}/blocks"
    packets = rows.mapInArrow(_number_chunks(path, files, max(16, size // BUCKET_BYTES)), "bucket long, block long, file string, packet binary")
    packets = work.save(packets.repartition("bucket").sortWithinPartitions("bucket"), "packets")
    known = packets.where("packet IS NOT NULL").select("bucket", "block", "packet").mapInArrow(_segment_once(path), "block long, ids binary")
    known = work.save(known.unionByName(packets.where("file IS NOT NULL").select("block", "file"), allowMissingColumns=True), "known")
    work.drop("packets")
    both = known.repartition("block").sortWithinPartitions(F.col("block"), F.col("file").isNotNull())
    ids = pa.list_(pa.int32())
    names = [("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] if digests else [("ids", ids, "array<int>"), ("decoded", pa.string(), "string")]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *(n[:2] for n in names)])
    return both.mapInArrow(_join_back(path, files, _digest if digests else _whole, schema), ", ".join(["doc_id long", "n_tokens long", *(f"{n} {kind}" for n, _, kind in names)]))


def op13_pieces(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests; odd rows as ``encode`` states them."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
