"""A partitioned message log in a shared folder, as a Spark data source: offset ranges in batch, admitted streams, keyed writes.

It has the columns and the options of a message broker's connector, so ``messages`` reads either one:

    spark.dataSource.register(MessageLog)
    rows.write.format("message_log").mode("append").options(path=..., topic="events", partitions=6).save()
    spark.read.format("message_log").options(path=..., topic="events", startingOffsets='{"0": 10}').load()

Messages lie in Parquet files under ``path/topic/data``. A commit is one small file under ``path/topic/commits`` that
names its files with their partitions and first offsets: a write is seen as a whole or not at all, an aborted one
leaves nothing, and a stream's batch that is written again is known by its number. One writer a topic at a time.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MESSAGE = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
_stored = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("timestamp", pa.timestamp("us", "UTC"))])
#: Messages that one task reads at most, and of which a writer holds so many for each partition.
ROWS_PER_TASK, ROWS_HELD = 50_000, 10_000


@dataclass(frozen=True)
class Segment:
    """Messages ``first`` to ``first + rows - 1`` of a partition."""

    partition: int
    first: int
    rows: int
    size: int
    file: str


class Topic:
    """The files of one topic."""

    def __init__(self, path: str, name: str):
        self.name = name
        self.store, root = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
        self.root = f"{root.rstrip('/')}/{name}"

    def load(self, file: str) -> dict | None:
        if self.store.get_file_info(f"{self.root}/{file}").type == pafs.FileType.NotFound:
            return None
        with self.store.open_input_stream(f"{self.root}/{file}") as source:
            return json.loads(source.read())

    def dump(self, value: dict, file: str) -> None:
        """Whole or not at all: the file gets its name when it is complete."""
        at = f"{self.root}/{file}"
        self.store.create_dir(at.rpartition("/")[0], recursive=True)
        with self.store.open_output_stream(f"{at}.tmp") as out:
            out.write(json.dumps(value).encode())
        self.store.move(f"{at}.tmp", at)

    def commits(self) -> list[dict]:
        found = self.store.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return [self.load(f"commits/{x.base_name}") for x in sorted(found, key=lambda x: x.base_name) if x.base_name.endswith(".json")]

    def segments(self) -> list[Segment]:
        return [Segment(*x) for commit in self.commits() for x in commit["segments"]]

    def append(self, files: list[tuple[int, int, int, str]], name: str) -> bool:
        """Commit (partition, rows, bytes, file) in their order; ``name`` tells a commit from others, and one that is known is left as it is."""
        commits = self.commits()
        if any(c["name"] == name for c in commits):
            return False
        next_of = ends([Segment(*x) for c in commits for x in c["segments"]])
        added = []
        for partition, rows, size, file in files:
            added.append(Segment(partition, next_of.get(partition, 0), rows, size, file))
            next_of[partition] = added[-1].first + rows
        self.dump({"name": name, "segments": [astuple(x) for x in added]}, f"commits/{len(commits):012d}.json")
        return True

    def remove(self, files: list[str]) -> None:
        for file in files:
            if self.store.get_file_info(f"{self.root}/data/{file}").type != pafs.FileType.NotFound:
                self.store.delete_file(f"{self.root}/data/{file}")


def ends(segments: list[Segment]) -> dict[int, int]:
    """The offset after the last message of each partition."""
    found: dict[int, int] = {}
    for x in segments:
        found[x.partition] = max(found.get(x.partition, 0), x.first + x.rows)
    return found


def starts(segments: list[Segment]) -> dict[int, int]:
    """The first offset of each partition."""
    found: dict[int, int] = {}
    for x in segments:
        found[x.partition] = min(found.get(x.partition, x.first), x.first)
    return found


def offsets_of(named: str, segments: list[Segment], left_out: int = -2) -> dict[int, int]:
    """``earliest``, ``latest``, or JSON of offsets by partition (-2: earliest, -1: latest; ``left_out`` for those it leaves out)."""
    first, last = starts(segments), ends(segments)
    if named in ("earliest", "latest"):
        return first if named == "earliest" else last
    given = {int(p): int(o) for p, o in json.loads(named).items()}
    return {p: {-2: first[p], -1: last[p]}.get(given.get(p, left_out), given.get(p, left_out)) for p in first}


@dataclass
class Range(InputPartition):
    """What one task reads: of each file of one partition the rows from ``skip`` on, ``take`` of them, the first at ``first``."""

    partition: int
    parts: list[tuple[str, int, int, int]]


def ranges(segments: list[Segment], start: dict[int, int], end: dict[int, int], most: int = ROWS_PER_TASK) -> list[Range]:
    """Offset ranges as tasks of ``most`` messages at most; a large range of one partition makes several."""
    found = []
    for partition in sorted(end):
        lo, hi = start.get(partition, 0), end[partition]
        held, n = [], 0
        for x in sorted((x for x in segments if x.partition == partition), key=lambda x: x.first):
            at, to = max(lo, x.first), min(hi, x.first + x.rows)
            while at < to:
                take = min(to - at, most - n)
                held.append((x.file, at - x.first, take, at))
                at, n = at + take, n + take
                if n == most:
                    found.append(Range(partition, held))
                    held, n = [], 0
        if held:
            found.append(Range(partition, held))
    return found


def read_range(path: str, topic: str, part: Range) -> Iterator[pa.RecordBatch]:
    own = Topic(path, topic)
    for name, skip, take, offset in part.parts:
        with own.store.open_input_file(f"{own.root}/data/{name}") as source:
            held = pq.ParquetFile(source)
            groups = list(range(held.num_row_groups))
            while groups and skip >= (n := held.metadata.row_group(groups[0]).num_rows):  # not read at all
                skip, groups = skip - n, groups[1:]
            for batch in held.iter_batches(10_000, groups):
                rows = batch.slice(skip, take)
                skip, take = max(0, skip - len(batch)), take - len(rows)
                if not len(rows):
                    if take:
                        continue
                    break
                n = len(rows)
                columns = [rows.column(0), rows.column(1), pa.repeat(topic, n), pa.repeat(pa.scalar(part.partition, pa.int32()), n), pa.array(np.arange(offset, offset + n)), rows.column(2)]
                offset += n
                yield pa.RecordBatch.from_arrays(columns, names=["key", "value", "topic", "partition", "offset", "timestamp"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[Range]:
        segments = Topic(self.options["path"], self.options["topic"]).segments()
        start = offsets_of(self.options.get("startingOffsets", "earliest"), segments)
        end = offsets_of(self.options.get("endingOffsets", "latest"), segments, -1)
        check_offsets(start, segments)
        check_offsets(end, segments)
        return ranges(segments, start, end, int(self.options.get("rowsPerTask", ROWS_PER_TASK))) or [Range(0, [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.options["path"], self.options["topic"], partition)


def check_offsets(start: dict[int, int], segments: list[Segment]) -> None:
    """Offsets of messages that are gone, or not there yet, are an error rather than a silent gap."""
    first, last = starts(segments), ends(segments)
    for p, at in start.items():
        if not first.get(p, 0) <= at <= last.get(p, 0):
            raise ValueError(f"offset {at} of partition {p} isn't between {first.get(p, 0)} and {last.get(p, 0)}")


def admit(start: dict[int, int], end: dict[int, int], segments: list[Segment], most_rows: int | None = None, most_bytes: int | None = None) -> dict[int, int]:
    """How far a batch may go: so many messages and bytes at most, the partitions taking turns by what they have waiting.

    Each gets its share of the messages, rounded down, and what is left goes to the first ones that have more. Bytes
    are those of whole files; a batch has one file at least, so that it gets ahead.
    """
    waiting = {p: end[p] - start.get(p, 0) for p in sorted(end)}
    if most_bytes is not None:
        size, reached = 0, {p: start.get(p, 0) for p in waiting}
        for x in sorted(segments, key=lambda x: (x.first + x.rows, x.partition)):
            if x.partition in waiting and x.first + x.rows > reached[x.partition]:
                if size and size + x.size > most_bytes:
                    break
                size, reached[x.partition] = size + x.size, min(x.first + x.rows, end[x.partition])
        waiting = {p: reached[p] - start.get(p, 0) for p in waiting}
    total = sum(waiting.values())
    if most_rows is not None and total > most_rows:
        taken = {p: n * most_rows // total for p, n in waiting.items()}
        left = most_rows - sum(taken.values())
        for p, n in waiting.items():
            more = min(left, n - taken[p])
            taken[p], left = taken[p] + more, left - more
        waiting = taken
    return {p: start.get(p, 0) + n for p, n in waiting.items()}


class _StreamReader(DataSourceStreamReader):
    """A stream that admits messages by ``maxOffsetsPerTrigger`` and ``maxBytesPerTrigger``, and no more of them at all after ``maxMessages`` or ``maxSeconds``.

    Where a ``group`` began and how far its batches are planned is kept with the topic, written when a batch is
    planned, so a restarted stream admits from there. A group goes with one checkpoint, which decides what is read:
    a batch that failed is read again as it was planned, the first one too.
    """

    def __init__(self, options: dict):
        self.options, self.topic = options, Topic(options["path"], options["topic"])
        self.group = f"groups/{options['group']}.json" if options.get("group") else None
        known = self.topic.load(self.group) if self.group else None
        segments = self.topic.segments()
        began = offsets_of(options.get("startingOffsets", "earliest"), segments)
        self.initial, self.first = ({int(p): o for p, o in known[k].items()} if known else began for k in ("initial", "planned"))
        self.planned, self.began = dict(self.first), time.monotonic()

    def _number(self, name: str) -> float | None:
        return float(self.options[name]) if self.options.get(name) else None

    def initialOffset(self) -> dict:
        return {str(p): o for p, o in self.initial.items()}

    def latestOffset(self) -> dict:
        seconds, messages, rows = (self._number(n) for n in ("maxSeconds", "maxMessages", "maxOffsetsPerTrigger"))
        if seconds is None or time.monotonic() - self.began < seconds:
            segments = self.topic.segments()
            if messages is not None:
                messages -= sum(self.planned.values()) - sum(self.first.get(p, 0) for p in self.planned)
            limits = [int(x) for x in (messages, rows) if x is not None]
            self.planned = admit(self.planned, ends(segments), segments, min(limits) if limits else None, self._number("maxBytesPerTrigger"))
        return {str(p): o for p, o in self.planned.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        lo, hi = ({int(p): o for p, o in x.items()} for x in (start, end))
        segments = self.topic.segments()
        check_offsets(lo, segments)
        if any(hi[p] > self.planned.get(p, 0) for p in hi):  # a batch planned before a restart
            self.planned = {p: max(o, self.planned.get(p, 0)) for p, o in hi.items()}
        if self.group:
            self.topic.dump({"initial": self.initialOffset(), "planned": end}, self.group)
        return ranges(segments, lo, hi, int(self.options.get("rowsPerTask", ROWS_PER_TASK)))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.options["path"], self.options["topic"], partition)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, int, int, str]]


class _Writing:
    """Rows have a ``value``, and may have a ``key``, a ``partition`` and a ``timestamp``. Without a partition the key
    decides (equal keys go to one partition, in order), without a key rows take turns."""

    def __init__(self, options: dict):
        self.options, self.name = options, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own, n = Topic(self.options["path"], self.options["topic"]), int(self.options.get("partitions", 1))
        own.store.create_dir(f"{own.root}/data", recursive=True)
        now, turn = pa.scalar(int(time.time() * 1_000_000), pa.timestamp("us")).cast(_stored.field("timestamp").type), 0
        held: dict[int, list[pa.Table]] = {}
        writers: dict[int, tuple[str, pq.ParquetWriter]] = {}
        rows: dict[int, int] = {}

        def flush(partition: int) -> None:
            if partition not in writers:
                name = f"{partition}-{uuid.uuid4().hex}.parquet"
                writers[partition] = name, pq.ParquetWriter(f"{own.root}/data/{name}", _stored, compression="zstd", filesystem=own.store)
            found = pa.concat_tables(held.pop(partition))
            writers[partition][1].write_table(found)
            rows[partition] = rows.get(partition, 0) + len(found)

        for batch in iterator:
            names, size = batch.schema.names, len(batch)
            key, value, when = (batch.column(f.name).cast(f.type) if f.name in names else pa.nulls(size, f.type) for f in _stored)
            placed = pa.Table.from_arrays([key, value, pc.fill_null(when, now)], schema=_stored)
            to = batch.column("partition").cast(pa.int32()).to_pylist() if "partition" in names else [None] * size
            for i, p in enumerate(to):
                if p is None:
                    k = key[i].as_py()
                    to[i], turn = (zlib.crc32(k) % n, turn) if k is not None else (turn % n, turn + 1)
            dealt = np.array(to, np.int32)
            for p in np.unique(dealt).tolist():
                held.setdefault(p, []).append(placed.take(np.flatnonzero(dealt == p)))
                if sum(map(len, held[p])) >= ROWS_HELD:
                    flush(p)
        for p in list(held):
            flush(p)
        for _, writer in writers.values():
            writer.close()
        return Written([(p, rows[p], own.store.get_file_info(f"{own.root}/data/{name}").size, name) for p, (name, _) in sorted(writers.items())])

    def _commit(self, messages: list[Written | None], name: str) -> None:
        own = Topic(self.options["path"], self.options["topic"])
        files = [f for m in messages if m for f in m.files]
        if not own.append(files, name):  # this batch is there already
            own.remove([f[3] for f in files])

    def _abort(self, messages: list[Written | None]) -> None:
        Topic(self.options["path"], self.options["topic"]).remove([f[3] for m in messages if m for f in m.files])


class _Writer(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, self.name)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    """Batches are known by ``writer`` (which a restarted stream gives again) and their number."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, f"{self.options['writer']}-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        if not self.options.get("writer"):
            raise ValueError("a stream's writer needs a name: option writer")
        return _StreamWriter(self.options)


def messages(spark: SparkSession, topic: str, where: str, stream: bool = False, **options: str | int | None) -> DataFrame:
    """Messages of a topic: of a broker where ``where`` is a list of servers, else of a log in that folder.

    Both take startingOffsets, endingOffsets (batch) and maxOffsetsPerTrigger (stream).
    """
    reader = spark.readStream if stream else spark.read
    given = {k: v for k, v in options.items() if v is not None}
    if "/" in where:
        spark.dataSource.register(MessageLog)
        return reader.format("message_log").options(path=where, topic=topic, **given).load()
    rows = reader.format("kafka").options(**{"kafka.bootstrap.servers": where, "subscribe": topic, **given}).load()
    return rows.select("key", "value", "topic", "partition", "offset", "timestamp")


def send(rows: DataFrame, topic: str, where: str, partitions: int = 1) -> None:
    """Append rows (value, and perhaps key, partition, timestamp) to a topic of a log's folder."""
    rows.sparkSession.dataSource.register(MessageLog)
    rows.write.format("message_log").mode("append").options(path=where, topic=topic, partitions=partitions).save()
