"""Web archives with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of its own, in archives of some 32 MB. Equal payloads are
stored once: the capture with the smallest page_id is a ``response``, others are ``revisit`` records that
refer to it. A capture is known by (URL key, page_id); the key has the host reversed, so that a site's pages
are neighbours.

Level one: all captures sorted by key, in shards by ranges, each a file of compressed blocks of BLOCK lines.
Level two: a sparse directory beside each shard, one entry a block (first key, place, length). A look-up
binary-searches the shards' first keys (one a shard, the number of range partitions), then the shard's
directory, reads that one block by range, and binary-searches its lines; the line names the archive and the
range of bytes with the record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Work, batches_of, filesystem, lean

BLOCK = 1000
ARCHIVE_BYTES = 32 << 20
#: Bytes of records that a task of a look-up or of reading has to do with.
TASK_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands for a null page_id in keys, before all others.
NO_ID = -(1 << 63)

_entry = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
_entry_ddl = "url_key string, page_id long, file string, at long, length long"
_found = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def url_key(url: str | None) -> str:
    """The URL with its host reversed: http://www.site.org/a?b -> org,site,www)/a?b; no scheme, no fragment."""
    url = re.sub(r"[\x00-\x20\x7f]", "", url or "")
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record as a gzip member."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    clean = lambda x: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {clean(url)}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        lines += [f"WARC-Refers-To-Target-URI: {clean(refers_url)}", f"WARC-Refers-To-Date: {DATE}"] if refers_url else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; a wrong digest is an error."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    known = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != known):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload damaged")
    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x[10:-1])
    return number(fields["WARC-Record-ID"]), size, known, kind, number(fields.get("WARC-Refers-To"))


def write_archives(pages: DataFrame, work: Work, least_bytes: int = 0) -> DataFrame:
    """Write all pages; (url_key, page_id, file, at, length) of every record."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull(), F.concat_ws(":", F.sha1(F.col("html").cast("binary")), F.octet_length("html"))))
    first = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"))
    first = first.where("first.page_id < last").select("key", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    joined = rows.join(first, "key", "left").select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"), "first_url")
    root = f"{work.uri}/warc"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(root)
        store.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            entries = []
            for page_id, url, html, refers_to, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # a repeated attempt writes files of its own
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                member = record(page_id, url, html.encode("utf-8", "replace"), refers_to, first_url)
                out.write(member)
                entries.append((url_key(url), NO_ID if page_id is None else page_id, name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield from batches_of(entries, _entry)
        if out is not None:
            out.close()

    return work.save(joined.mapInArrow(lean(write), _entry_ddl), "entries")


def build_index(entries: DataFrame, work: Work) -> list[tuple[bytes, int, str]]:
    """Write both levels; the shards' first keys and file names, in order (as many as range partitions)."""
    root = f"{work.uri}/index"
    shard = pa.schema([("first_key", pa.binary()), ("first_id", pa.int64()), ("file", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(root)
        store.create_dir(folder, recursive=True)
        name, out, at, directory = uuid.uuid4().hex, None, 0, []
        lines: list[tuple] = []

        def flush() -> None:
            nonlocal out, at
            out = out or store.open_output_stream(f"{folder}/{name}.blocks", compression=None)
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode("utf-8", "surrogatepass"))
            out.write(data)
            directory.append((lines[0][0], lines[0][1], at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                if len(lines) >= BLOCK:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{folder}/{name}.directory", compression=None) as file:
                file.write(json.dumps(directory).encode())
            yield from batches_of([(directory[0][0].encode(), directory[0][1], name)], shard)

    ordered = entries.select(*_entry.names).repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "at")
    shards = work.save(ordered.mapInArrow(lean(write), "first_key binary, first_id long, file string"), "shards")
    return sorted((bytes(r.first_key), r.first_id, r.file) for r in shards.collect())


class Index:
    """Look-ups in a written index, from any machine."""

    def __init__(self, root: str, shards: list[tuple[bytes, int, str]]):
        self.store, self.folder = filesystem(root)
        self.shards, self.firsts = shards, [s[:2] for s in shards]
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(4)(self._block)

    def _directory(self, name: str) -> tuple[list, list]:
        with self.store.open_input_file(f"{self.folder}/{name}.directory") as file:
            entries = json.loads(file.read())
        return [(k.encode(), i) for k, i, _, _ in entries], [(at, n) for _, _, at, n in entries]

    def _block(self, name: str, at: int, n: int) -> tuple[list, list]:
        with self.store.open_input_file(f"{self.folder}/{name}.blocks") as file:
            lines = [json.loads(x) for x in zlib.decompress(file.read_at(n, at)).decode("utf-8", "surrogatepass").split("\n")]
        return [(x[0].encode(), x[1]) for x in lines], lines

    def find(self, key: str, page_id: int | None = None) -> Iterator[tuple]:
        """All captures of a key, or the one of a page_id."""
        low = (key.encode(), NO_ID if page_id is None else page_id)
        high = (key.encode(), (1 << 63) - 1 if page_id is None else page_id)
        for shard in range(max(0, bisect_left(self.firsts, low) - 1), bisect_right(self.firsts, high)):
            name = self.shards[shard][2]
            firsts, ranges = self.directory(name)
            for block in range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high)):
                keys, lines = self.block(name, *ranges[block])
                yield from lines[bisect_left(keys, low) : bisect_right(keys, high)]


class Archive:
    """Archives with their index."""

    def __init__(self, work: Work, shards: list[tuple[bytes, int, str]], n_bytes: int):
        self.work, self.shards = work, shards
        #: Tasks by the bytes that lie behind the captures, which themselves are small.
        self.tasks = 1 + n_bytes // TASK_BYTES

    @classmethod
    def write(cls, pages: DataFrame, least_bytes: int = 0) -> Archive:
        """Write every row of ``pages`` (page_id, url, html; other columns are left aside).

        A null html is an empty payload; payloads of at least ``least_bytes`` are stored once. A row with a null
        page_id is a response of its own. Rows that repeat a page_id are all written; one with the smallest
        page_id of its payload is a response (rows that repeat it, with that payload, all are). A null or odd URL is
        its own key; a very long html is one record. Empty tables give empty archives.
        """
        work = Work(pages.sparkSession, "warc")
        entries = write_archives(pages, work, least_bytes)
        shards = build_index(entries, work)
        n_bytes = entries.agg(F.coalesce(F.sum("length"), F.lit(0))).collect()[0][0]
        work.drop("entries")
        return cls(work, shards, n_bytes)

    def look_up(self, queries: DataFrame) -> DataFrame:
        """Captures of (url_key, page_id), or of a url_key where page_id is null: (url_key, page_id, file, at, length)."""
        root, shards = f"{self.work.uri}/index", self.shards

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(root, shards)
            for batch in batches:
                yield from batches_of((tuple(x) for key, i in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in index.find(key, i)), _entry)

        ordered = queries.select("url_key", "page_id").distinct().repartitionByRange(self.tasks, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
        return ordered.mapInArrow(lean(search), _entry_ddl)

    def fetch(self, captures: DataFrame) -> DataFrame:
        """Read the records of captures by range."""
        root = f"{self.work.uri}/warc"

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            store, folder = filesystem(root)
            name, file = None, None
            for batch in batches:
                for own, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if own != name:
                        if file is not None:
                            file.close()
                        name, file = own, store.open_input_file(f"{folder}/{own}")
                    yield parse(file.read_at(n, at))

        ordered = captures.select("file", "at", "length").repartitionByRange(self.tasks, "file", "at").sortWithinPartitions("file", "at")
        return ordered.mapInArrow(lean(lambda b: batches_of(read(b), _found)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def keys_of(pages: DataFrame) -> DataFrame:
    """(url_key, page_id) of pages, as the index has them."""
    schema = pa.schema([("url_key", pa.string()), ("page_id", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batches_of(((url_key(u), NO_ID if i is None else i) for i, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)), schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(keys, "url_key string, page_id long")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = Archive.write(pages)
    return archive.fetch(archive.look_up(keys_of(pages)))
