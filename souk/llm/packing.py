"""Best-fit packing of token sequences by linear grouping.

Only counts by length decide how sequences are filled, so planning is the driver's work and doesn't grow
with the corpus: it sees at most ``capacity`` lengths.

1. Pieces over an eighth of the capacity are large. Sorted by length they are cut into groups of equal
   cardinality, and each length is rounded up to its group's greatest: few sizes remain.
2. A configuration is a multiset of these sizes that fits. The linear programme that covers all large
   pieces with the fewest configurations is solved by column generation (a knapsack finds each column);
   whole parts are kept and what is left over is packed first-fit, longest first.
3. Actual pieces take the places of rounded sizes, which leaves room in most sequences. Those that are filled
   worse than a share of the capacity are dissolved again.
4. Small pieces and those of dissolved sequences go, longest first, where they fit best: into the fullest
   sequence with room. Of the SHARES tried the one that takes the fewest sequences wins.

The plan is a list of runs: pieces of one length, numbered from ``rank`` on, go one each to consecutive
sequences, all at one offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Work, batches_of, lean, number_rows, sliced
from souk.llm.tokens import encoder, forget, vocabulary_file

CAPACITY = 2048
GROUPS = 24
#: Sequences filled less than this are dissolved; the last dissolves all.
SHARES = (0.0, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999, 1.0, 1.01)
_pieces = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, and before them what is over."""
    at, size = 0, n % capacity or min(n, capacity)
    while at < n:
        yield at, size
        at, size = at + size, capacity


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with the checksums of their ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids_of, end = encoder(path).ids, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in ((i, t) for part in sliced(batch) for i, t in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                ids = ids_of(text or "") + end
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    yield doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])
        forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(lambda b: batches_of(rows(b), _pieces, 5000)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Multisets of sizes (how often each) and how many sequences to fill with each; they cover what is wanted."""
    k = len(sizes)
    need = np.array(wanted, float)
    base = np.diag([float(capacity // s) for s in sizes])
    for _ in range(60 * k):
        worth = np.linalg.solve(base.T, np.ones(k))
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = np.array(sizes)
        for c in range(min(sizes), capacity + 1):
            usable = order <= c
            got = np.where(usable, best[np.maximum(c - order, 0)] + worth, -1)
            j = int(got.argmax())
            best[c], take[c] = (got[j], j) if got[j] > best[c - 1] else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if take[c] >= 0:
                column[take[c]] += 1
                c -= sizes[take[c]]
            else:
                c -= 1
        amounts, step = np.linalg.solve(base, need), np.linalg.solve(base, column)
        limits = [amounts[i] / step[i] if step[i] > 1e-9 else np.inf for i in range(k)]
        base[:, int(np.argmin(limits))] = column
    amounts = np.linalg.solve(base, need)
    out, left = [], need.astype(int)
    for i in np.argsort(-amounts):
        config = base[:, i].round().astype(int)
        times = int(amounts[i] + 1e-9)
        if times > 0:
            out.append((config.tolist(), times))
            left = left - config * times
    rest: list[tuple[int, list[int]]] = []
    for j in np.argsort(-np.array(sizes)):
        for _ in range(max(0, int(left[j]))):
            for i, (room, config) in enumerate(rest):
                if room >= sizes[j]:
                    config[j] += 1
                    rest[i] = (room - sizes[j], config)
                    break
            else:
                config = [0] * k
                config[j] = 1
                rest.append((capacity - sizes[j], config))
    return out + [(config, 1) for _, config in rest]


def _filled(counts: dict[int, int], capacity: int, groups: int) -> list[tuple[int, list[int]]]:
    """Configurations of rounded sizes with actual pieces in their places: (sequences, lengths in each)."""
    large = sorted(((x, n) for x, n in counts.items() if capacity // 8 < x < capacity), reverse=True)
    if not large:
        return []
    total = sum(n for _, n in large)
    share = -(-total // min(groups, total))
    members: list[list[list[int]]] = [[]]
    full = 0
    for length, n in large:
        while n:
            if full == share:
                members.append([])
                full = 0
            m = min(n, share - full)
            members[-1].append([length, m])
            full, n = full + m, n - m
    merged: list[list[list[int]]] = []
    for group in members:
        if merged and merged[-1][0][0] == group[0][0]:
            merged[-1] += group
        else:
            merged.append(group)
    sizes = [group[0][0] for group in merged]
    out: list[tuple[int, list[int]]] = []
    for config, times in configurations(sizes, [sum(n for _, n in group) for group in merged], capacity):
        parts: list[tuple[int, list[int]]] = [(times, [])]
        for j in (j for j, often in enumerate(config) for _ in range(often)):
            found = []
            for n, held in parts:
                while n and merged[j]:
                    length, there = merged[j][0]
                    m = min(n, there)
                    found.append((m, [*held, length]))
                    n -= m
                    if m == there:
                        merged[j].pop(0)
                    else:
                        merged[j][0][1] -= m
                if n:
                    found.append((n, held))
            parts = found
        out += [(n, held) for n, held in parts if held]
    return out


def _best_fit(counts: dict[int, int], kept: list[tuple[int, list[int]]], capacity: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The number of sequences, and the runs: those that are kept, and all other pieces, longest first, where they fit best."""
    runs: list[tuple[int, int, int, int, int]] = []
    next_rank: dict[int, int] = defaultdict(int)
    open_by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, next_rank[length], n, sequence, offset))
        next_rank[length] += n

    def leave(room: int, sequence: int, n: int) -> None:
        if room and n:
            if not open_by_room[room]:
                insort(rooms, room)
            open_by_room[room].append((sequence, n))

    for n, held in kept:
        offset = 0
        for length in held:
            place(length, n, sequences, offset)
            offset += length
        leave(capacity - offset, sequences, n)
        sequences += n
    for length in sorted(counts, reverse=True):
        n = counts[length] - next_rank[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                m = -(-n // (capacity // length))
                leave(capacity, sequences, m)
                sequences += m
                continue
            room = rooms[at]
            sequence, there = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop(at)
            each = min(room // length, n)
            m = min(there, n // each)
            leave(room, sequence + m, there - m)
            for t in range(each):
                place(length, m, sequence, capacity - room + t * length)
            leave(room - each * length, sequence, m)
            n -= m * each
    return sequences, runs


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank, n, sequence, offset) that place ``counts[length]`` pieces of each length."""
    parts = _filled(counts, capacity, groups)
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best: tuple[int, list] | None = None
    for share in SHARES:
        found = _best_fit(counts, [(n, held) for n, held in parts if sum(held) >= share * capacity], capacity)
        if best is None or found[0] < best[0]:
            best = found
        if best[0] == least:
            break
    return best[1]


def assign(numbered: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Each piece's sequence and offset, by its length and its number among those of that length."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]
    schema = pa.schema([*_pieces, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "rank"))
            run = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            columns = [batch.column(f.name) for f in _pieces]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], schema=schema)

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Where every piece of every document goes.

    A null text is an empty one: its sequence is the end id alone. Rows that repeat a doc_id are packed each
    for itself, a null doc_id stays null; other columns are left aside. A very long text is cut into as many
    pieces as it takes; pieces of one length are ranked by (doc_id, piece, checksum). An empty table gives an
    empty result.
    """
    work = Work(docs.sparkSession, "packing")
    found = work.save(pieces(docs, path or vocabulary_file(), end_id, capacity), "pieces")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbered = number_rows(work, found, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", "by_length")
    return assign(numbered, plan(counts, capacity))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
