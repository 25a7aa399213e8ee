"""Substring dedup: remove repeated word windows, found with a count-min prefilter.

A window is SIZE consecutive words of one document. Grouping all windows exactly would shuffle one row for
every word of the corpus; few are repeated. So texts are first made distinct (all windows of a later copy of
a whole text are repeated, nothing needs to be found), and two passes follow over the distinct texts:

* Blocks of some texts count in how many of them a window occurs, in a count-min sketch: DEPTH rows of counters,
  cut into stripes of fixed width whose number grows with the corpus. A window is counted by its *anchor*: of
  its ANCHOR-word shingles the one with the least hash. Equal windows have equal anchors, so a window is in no
  more texts than its anchor, and neighbours mostly share theirs, so there is a quarter as much to count. The
  sketches of a stripe are summed, and each block is told which of its counters stand at two or more in the
  sum. A sum never underestimates, so no repeated window is lost. Only counters above 0 travel, once a block,
  so a passage that a third of all texts share is as many numbers as there are blocks.
* The blocks read their texts again; windows whose anchor has all its counters at two or more are grouped
  exactly, by 96 bits of hash (among 10**12 windows two differ with equal hashes by a chance of 1e-5).
  Windows of a group are repeated in all documents but the one with the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Chunk, Work, batches_of, chunks, lean, mix, window_hashes

SIZE = 13
ANCHOR = 8
DEPTH = 2
#: Counters of a stripe's row, and counters in a row for each anchor of the corpus.
STRIPE = 1 << 22
WIDTH = 8
#: Bytes of text for an anchor, about.
BYTES = 24
#: Texts of a block, as a power of two.
BLOCK = 8
_PLACES = (DEPTH * STRIPE).bit_length() - 1
_TWICE = np.uint32(1 << 31)


def anchors(hashes: np.ndarray, starts: np.ndarray, size: int = SIZE, anchor: int = ANCHOR) -> np.ndarray:
    """For the windows that start at ``starts``, by the words' hashes: their anchors' hashes."""
    shingles = window_hashes(hashes, anchor, 5)
    least = shingles[starts]
    for j in range(1, size - anchor + 1):
        least = np.minimum(least, shingles[starts + j])
    return least


def distinct_anchors(chunk: Chunk, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, text) of a chunk, once a text."""
    _, starts, owner = chunk.windows(size)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least = anchors(chunk.hashes, starts, size, anchor)
    order = np.lexsort((least, owner))
    least, owner = least[order], owner[order]
    first = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
    return least[first], owner[first]


def counters(keys: np.ndarray, stripes: int) -> np.ndarray:
    """The DEPTH counters of every anchor, a row each: the stripe (of a power of two), then the place in it."""
    keys = mix(keys + np.uint64(1))  # anchors are least of some hashes, so their leading bits are not even
    stripe = (keys >> np.uint64(65 - stripes.bit_length())) << np.uint64(_PLACES) if stripes > 1 else np.zeros(len(keys), np.uint64)
    low = keys & np.uint64(0xFFFFFFFF)
    return np.stack([stripe | np.uint64(row * STRIPE) | mix(low + np.uint64((row + 1) << 40)) & np.uint64(STRIPE - 1) for row in range(DEPTH)])


def sketch(found: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Blocks' sketches: (block, stripe, packed counters) by the counters of the blocks' anchors, given once a text."""
    numbers, block = np.unique(block, return_inverse=True)
    bits = np.uint64(64 - int(len(numbers)).bit_length())
    cells, n = np.unique(found.reshape(-1) | np.tile(block.astype(np.uint64) << bits, DEPTH), return_counts=True)
    group = cells >> np.uint64(_PLACES)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    packed = (cells & np.uint64(DEPTH * STRIPE - 1)).astype(np.uint32) | np.where(n > 1, _TWICE, np.uint32(0))
    of_block = (cells[first] >> bits).astype(np.int64)
    stripe = (cells[first] & ((np.uint64(1) << bits) - np.uint64(1))) >> np.uint64(_PLACES)
    return numbers[of_block], stripe.astype(np.int64), [x.astype("<u4").tobytes() for x in np.split(packed, first[1:])]


def merge(packed: list[bytes]) -> np.ndarray:
    """The sum of a stripe's sketches; counters stop at 2."""
    total = np.zeros(DEPTH * STRIPE, np.uint8)
    for own in (np.frombuffer(x, "<u4") for x in packed):
        place = own & ~_TWICE
        total[place] = np.minimum(total[place] + np.where(own & _TWICE, np.uint8(2), np.uint8(1)), 2)
    return total


_sketch = pa.schema([("block", pa.int64()), ("stripe", pa.int64()), ("counters", pa.binary())])
_sketch_ddl = "block long, stripe long, counters binary"


def sketches(texts: DataFrame, stripes: int, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """(block, stripe, counters) of the blocks of ``texts`` (block, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, block = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            own, stripe, packed = sketch(counters(keys, stripes), block) if len(keys) else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(stripe, pa.int64()), pa.array(packed, pa.binary())], schema=_sketch)

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for chunk in chunks(batch.column(1)):
                keys, owner = distinct_anchors(chunk, size, anchor)
                held.append((keys, blocks[chunk.row + owner]))
                if sum(len(k) for k, _ in held) > 500_000:
                    yield flush()
        if held:
            yield flush()

    return texts.select("block", "text").mapInArrow(lean(run), _sketch_ddl)


def repeated_counters(parts: DataFrame) -> DataFrame:
    """(block, stripe, counters): of every block's counters those that stand at two or more in the sum of all sketches."""

    def answer(table: pa.Table) -> pa.Table:
        packed = table.column("counters").to_pylist()
        total = merge(packed)
        own = [np.frombuffer(x, "<u4") & ~_TWICE for x in packed]
        return table.set_column(2, "counters", pa.array([x[total[x] > 1].astype("<u4").tobytes() for x in own], pa.binary()))

    return parts.groupBy("stripe").applyInArrow(answer, _sketch_ddl).where("octet_length(counters) > 0")


_window = pa.schema([("high", pa.int64()), ("low", pa.int32()), ("doc_id", pa.int64()), ("number", pa.int64()), ("places", pa.list_(pa.int32()))])


def windows_to_group(texts: DataFrame, repeated: DataFrame, stripes: int, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """(high, low, doc_id, number, places) of the windows, once a text, whose anchor's counters all are among the block's ``repeated``."""

    def emit(batch: pa.RecordBatch, known: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, numbers = batch.column("doc_id").to_numpy(), batch.column("number").to_numpy()
        for chunk in chunks(batch.column("text")):
            _, starts, owner = chunk.windows(size)
            if not len(starts):
                continue
            cells = counters(anchors(chunk.hashes, starts, size, anchor), stripes)
            among = (known[np.minimum(np.searchsorted(known, cells), len(known) - 1)] == cells).all(axis=0)
            at, owner = starts[among], owner[among]
            if not len(at):
                continue
            high = window_hashes(chunk.hashes, size, 1)[at].view(np.int64)
            low = (window_hashes(chunk.hashes, size, 2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            order = np.lexsort((at, low, high, owner))
            high, low, at, owner = high[order], low[order], at[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])]))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at - chunk.first[owner], pa.int32()))
            row = chunk.row + owner[first]
            yield pa.RecordBatch.from_arrays([pa.array(high[first]), pa.array(low[first]), pa.array(ids[row]), pa.array(numbers[row]), places], schema=_window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, told, known = None, [], None
        for batch in batches:
            blocks, is_text = batch.column("block").to_numpy(), batch.column("counters").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(blocks * 2 + is_text, prepend=-1)).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(batch)], strict=False):
                part = batch.slice(lo, hi - lo)
                if blocks[lo] != block:
                    block, told, known = blocks[lo], [], None
                if not is_text[lo]:
                    told += [np.frombuffer(x, "<u4").astype(np.uint64) | np.uint64(stripe << _PLACES) for stripe, x in zip(part.column("stripe").to_pylist(), part.column("counters").to_pylist(), strict=True)]
                    continue
                if known is None:
                    known = np.sort(np.concatenate([np.empty(0, np.uint64), *told]))
                if len(known):
                    yield from emit(part, known)

    # A block's counters come first, then its texts, batch by batch: Python never holds the texts of a whole block.
    both = texts.select("block", "number", "doc_id", "text").unionByName(repeated.select("block", "stripe", "counters"), allowMissingColumns=True)
    met = both.repartition("block").sortWithinPartitions(F.col("block"), F.col("counters").isNull())
    return met.mapInArrow(lean(run), "high long, low int, doc_id long, number long, places array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def later_windows(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """(key, first_id, places): by the hash of a text, its smallest doc_id and where that one has windows that a smaller doc_id has too."""
    work = Work(docs.sparkSession, "substring")
    rows = _keyed(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    # Of each text the copy with the smallest doc_id: copies meet as ids, and only that one's text moves on.
    firsts = work.save(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "firsts")
    one_each = rows.join(firsts, ["key", "doc_id"], "left_semi").groupBy("key", "doc_id").agg(F.first("text").alias("text"))
    numbered = one_each.withColumn("number", F.monotonically_increasing_id())
    texts = work.save(numbered.withColumn("block", F.shiftright("number", BLOCK)), "texts")
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    stripes = 1 << max(0, (n_bytes * WIDTH // (BYTES * STRIPE)).bit_length())
    repeated = work.save(repeated_counters(sketches(texts, stripes, size, anchor)), "repeated")
    windows = work.save(windows_to_group(texts, repeated, stripes, size, anchor), "windows")
    names = work.save(texts.select("number", "key"), "names")
    work.drop("texts", "repeated")
    first = windows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = work.save(first, "first")
    later = windows.join(first, ["high", "low"]).where("doc_id > first")
    places = work.save(later.groupBy("number").agg(F.flatten(F.collect_list("places")).alias("places")), "places")
    work.drop("windows", "first")
    out = firsts.withColumnRenamed("doc_id", "first_id").join(places.join(names, "number").drop("number"), "key", "left")
    out = work.save(out, "later")
    work.drop("firsts", "names", "places")
    return out


def remove(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): the words left of every document, joined by one space.

    A word goes if a window covers it that also starts in a document with a smaller doc_id, judged on the
    texts as they come. A null text has no words, and neither it nor one of fewer than ``size`` words has
    windows; a very long one is hashed in stretches. A row with a null doc_id is compared with none and keeps
    its words. Rows that repeat a doc_id are one document of several texts: each row is returned, and none
    repeats the others. Other columns are left aside; an empty table gives an empty result.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids, firsts, places = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for chunk in chunks(batch.column(1)):
                for i in range(len(chunk)):
                    words, row = chunk.bytes_of(i).split(), chunk.row + i
                    n = len(words)
                    if ids[row] is not None and firsts[row] is not None and firsts[row] < ids[row]:  # a later copy of a whole text
                        words = words if n < size else []
                    elif ids[row] is not None and places[row].is_valid:
                        covered = np.zeros(n + 1, np.int64)
                        at = places[row].values.to_numpy()
                        np.add.at(covered, at, 1)
                        np.add.at(covered, at + size, -1)
                        words = [w for w, k in zip(words, (np.cumsum(covered[:-1]) == 0).tolist(), strict=True) if k]
                    yield ids[row], n, n - len(words), b" ".join(words).decode()

    later = later_windows(docs, size, anchor)
    met = _keyed(docs).join(later, "key", "left").select("doc_id", "text", "first_id", "places")
    return met.mapInArrow(lean(lambda b: batches_of(cut(b), out)), "doc_id long, n_words long, n_removed long, kept_text string")


def op4_substring(spark, sf_dir: str) -> DataFrame:
    kept = remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
