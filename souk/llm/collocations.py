"""Collocations of each language: phrases whose parts stand together far more often than apart.

Vertical mining in the manner of SPAM. Texts become shards of one language; a shard keeps, for each of its words, a
compressed bitmap of the positions where it stands, with an empty position between pieces so that nothing reaches
over their ends. A phrase's bitmap has its last words' positions. Shifted by one and ANDed with the words' bitmaps
it gives the bitmaps of all longer phrases, whose popcounts are their numbers in the shard.

1. Shards are written, words are counted over all shards, rare ones fall out.
2. Every frequent word is extended by one word in every shard; pairs' popcounts are summed over shards, bucket by
   bucket of pairs' hashes, rare pairs fall out, and each shard gets its frequent pairs back.
3. Shards extend phrases depth-first, always by a word that makes a frequent pair with the last one; popcounts are
   summed again.
4. Counts of all frequent phrases are joined with those of their parts and of what they lie in.

A phrase's parts are as frequent as itself at least, so nothing is lost. No step's memory grows with the corpus: a
task holds one shard, a word or pair of any frequency has one row a shard. Texts are shuffled nowhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import SPACE, Work, batches_of, lean, mix, number_rows, pack_numbers, string_buffer, unpack_numbers, word_places

#: A shard ends with the texts that take it to so many words.
SHARD_WORDS = 2_000_000
#: Positions in one block of a bitmap.
BITS = 16
#: Blocks that are extended together.
AT_ONCE = 50_000
#: Words of all texts for each bucket of pairs: a task sums the pairs of one bucket.
BUCKET_WORDS = 2_000_000
#: Bytes of text that are cut into words at once.
_STRETCH = 1 << 20
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A-Z to lower case, ends of pieces to line ends.
TABLE = LETTERS.translate(bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9))
_END = ord("\n")


class Words:
    """Words of texts of one language, one after another: their bytes, lengths, and which of them begin a piece."""

    def __init__(self):
        self.n, self.parts = 0, []

    def add(self, texts: pa.Array) -> None:
        data, bounds = string_buffer(texts)
        lo, end, ended = int(bounds[0]), int(bounds[-1]), True
        while lo < end:
            hi = min(end, lo + _STRETCH)
            while hi < end and not SPACE[data[hi]] and not SPACE[TABLE[data[hi]]]:
                hi += 1  # a word is not cut
            part = np.frombuffer(data[lo:hi].tobytes().translate(TABLE), np.uint8)
            inner = bounds[(bounds >= lo) & (bounds <= hi)] - lo
            starts, stops = word_places(part, inner)
            if len(starts):
                ends = np.cumsum(part == _END, dtype=np.int32)
                begins = np.diff(ends[starts], prepend=0) > 0
                after = np.searchsorted(starts, inner)
                begins[after[after < len(starts)]] = True
                begins[0] |= ended
                self.parts.append((part[~SPACE[part]], (stops - starts).astype(np.int32), begins))
                self.n += len(starts)
                ended = bool(ends[-1] > ends[starts[-1]] or (after == len(starts)).any())
            else:
                ended = ended or bool(len(inner) or (part == _END).any())
            lo = hi

    def index(self) -> tuple[pa.Array, np.ndarray, bytes]:
        """Distinct words, how often each occurs, and their bitmaps."""
        data, sizes, begins = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
        words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        no = words.indices.to_numpy()
        places = np.arange(len(no)) + np.cumsum(begins)
        order = np.argsort(no, kind="stable")
        no, places = no[order], places[order]
        block, bit = places // BITS, np.uint16(1) << (places % BITS).astype(np.uint16)
        heads = np.flatnonzero((np.diff(no, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        return words.dictionary, np.bincount(no), pack(no[heads], block[heads], np.bitwise_or.reduceat(bit, heads))


def pack(word: np.ndarray, block: np.ndarray, bits: np.ndarray) -> bytes:
    """Bitmaps of all words of a shard, compressed: blocks that hold any position, by word, as steps from one to the next."""
    sizes = np.bincount(word).astype("<u4")
    raw = sizes.tobytes() + np.diff(block, prepend=0).astype("<i4").tobytes() + bits.astype("<u2").tobytes()
    return np.array([len(sizes), len(block)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, block, bits), sorted by word and block."""
    n_words, n = np.frombuffer(packed[:16], "<i8").tolist()
    raw = pa.decompress(packed[16:], decompressed_size=4 * n_words + 6 * n, codec="zstd", asbytes=True)
    sizes = np.frombuffer(raw, "<u4", n_words)
    block = np.cumsum(np.frombuffer(raw, "<i4", n, 4 * n_words), dtype=np.int64)
    return np.repeat(np.arange(n_words), sizes), block, np.frombuffer(raw, "<u2", n, 4 * (n_words + n))


class Shard:
    """Bitmaps of a shard's frequent words. ``ids`` are the words' numbers in all shards."""

    def __init__(self, packed: bytes, no: np.ndarray, ids: np.ndarray, pairs: np.ndarray | None = None):
        word, block, bits = unpack(packed)
        number = np.full(int(max(word.max(initial=-1), no.max(initial=-1))) + 1, -1)
        number[no] = np.arange(len(no))
        kept = number[word] >= 0
        self.ids, self.word, self.block, self.bits = ids, number[word[kept]], block[kept], bits[kept]
        order = np.argsort(self.block, kind="stable")
        self.own_word, self.own_bits = self.word[order], self.bits[order]
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(self.block, minlength=int(self.block.max(initial=-1)) + 3))])
        self.pairs = None
        if pairs is not None:  # of numbers in all shards
            by_id = np.argsort(ids)
            a, b = (by_id[np.searchsorted(ids, x, sorter=by_id)] for x in pairs)
            self.pairs = np.unique(a * len(ids) + b)

    def extend(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """All extensions of phrases by a word, from their bitmaps: (node, block, bits) are blocks of the phrases' bitmaps.

        Returns, by extension, its phrase and its word and the popcount of its bitmap; and its bitmap's blocks
        (extension, block, bits). With ``last`` (each phrase's last word) only frequent pairs are made.
        """
        over, shifted = bits >> np.uint16(BITS - 1), bits << np.uint16(1)  # what a shift moves to the next block, and what stays
        stay, move = np.flatnonzero(shifted), np.flatnonzero(over)
        node, block, bits = np.concatenate([node[stay], node[move]]), np.concatenate([block[stay], block[move] + 1]), np.concatenate([shifted[stay], over[move]])
        begin = self.first[block]
        n = self.first[block + 1] - begin
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(owner)) + np.repeat(begin - np.cumsum(n) + n, n)
        both = bits[owner] & self.own_bits[at]
        hit = np.flatnonzero(both)
        owner, word, both = owner[hit], self.own_word[at[hit]], both[hit]
        node, block = node[owner], block[owner]
        if last is not None:
            pair = last[node] * len(self.ids) + word
            found = np.searchsorted(self.pairs, pair)
            found[found == len(self.pairs)] = 0
            ok = np.flatnonzero(self.pairs[found] == pair) if len(self.pairs) else np.zeros(0, np.int64)
            node, block, word, both = node[ok], block[ok], word[ok], both[ok]
        key = node * len(self.ids) + word
        order = np.argsort(key, kind="stable")
        key, block, both = key[order], block[order], both[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.add.reduceat(np.bitwise_count(both).astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        own = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
        return key[heads] // max(1, len(self.ids)), key[heads] % max(1, len(self.ids)), counts, own, block, both

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of the words' bitmaps, some at once. A bitmap may be cut: popcounts of its parts add up."""
        for lo in range(0, len(self.word), AT_ONCE):
            yield self.word[lo : lo + AT_ONCE], self.block[lo : lo + AT_ONCE], self.bits[lo : lo + AT_ONCE]

    def all_pairs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(ids of the first words, of the second, numbers of occurrences)."""
        for word, block, bits in self.slices():
            first, second, counts, *_ = self.extend(word, block, bits)
            yield self.ids[first], self.ids[second], counts

    def phrases(self, longest: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Phrases of 3 words and more, by columns of their words' ids, and their numbers."""

        def deeper(words: list[np.ndarray], node: np.ndarray, block: np.ndarray, bits: np.ndarray):
            for lo in range(0, len(node), AT_ONCE):
                hi = lo + AT_ONCE
                parent, word, counts, own, own_block, own_bits = self.extend(node[lo:hi], block[lo:hi], bits[lo:hi], words[-1])
                if not len(word):
                    continue
                longer = [*(w[parent] for w in words), word]
                if len(longer) > 2:
                    yield [self.ids[w] for w in longer], counts
                if len(longer) < longest:
                    yield from deeper(longer, own, own_block, own_bits)

        yield from deeper([np.arange(len(self.ids))], self.word, self.block, self.bits)


_index = "shard long, lang string, no int, word string, n long, bitmaps binary"
_index_arrow = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("no", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("bitmaps", pa.binary())])


def _make_shards(most: int):
    """Of (lang, text): a row of bitmaps for each shard, and a row for each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, Words] = defaultdict(Words)

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            own = held.pop(lang)
            if not own.n:
                return
            words, counts, bitmaps = own.index()
            shard, made = part << 32 | made, made + 1

            def batch(n: int, *columns) -> pa.RecordBatch:
                filled = [pa.array([x] * n, t) if not isinstance(x, (pa.Array, np.ndarray)) else pa.array(x).cast(t) for x, t in zip(columns, _index_arrow.types, strict=True)]
                return pa.RecordBatch.from_arrays(filled, schema=_index_arrow)

            yield batch(1, shard, lang, None, None, None, bitmaps)
            for lo in range(0, len(words), 20_000):
                some = words.slice(lo, 20_000)
                yield batch(len(some), shard, lang, np.arange(lo, lo + len(some), dtype=np.int32), some, counts[lo : lo + len(some)], None)

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            at = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                held[lang].add(batch.column(1).take(pa.array(np.flatnonzero(at == i))))
                if held[lang].n >= most:
                    yield from flush(lang)
            while sum(x.n for x in held.values()) >= 2 * most:  # of many languages
                yield from flush(max(held, key=lambda x: held[x].n))
        for lang in list(held):
            yield from flush(lang)

    return lean(run)


def _shards(batches: Iterator[pa.RecordBatch], with_pairs: bool) -> Iterator[tuple[int, Shard]]:
    """Shards from rows sorted by (shard, kind): bitmaps (0), words (1), pairs (2)."""
    shard, packed = None, b""
    held: dict[int, list] = {1: [], 2: []}

    def made() -> tuple[int, Shard]:
        (no, ids), pairs = ([np.concatenate(x) for x in zip(*held[k], strict=True)] if held[k] else [np.zeros(0, np.int64)] * 2 for k in (1, 2))
        return shard, Shard(packed, no, ids, np.stack(pairs) if with_pairs else None)

    for batch in batches:
        own, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.diff(own * 4 + kind, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=False):
            if own[lo] != shard:
                if shard is not None:
                    yield made()
                shard, held = int(own[lo]), {1: [], 2: []}
            if kind[lo] == 0:
                packed = batch.column("bitmaps")[lo].as_py()
            elif kind[lo] == 1:
                held[1].append(tuple(batch.column(c).slice(lo, hi - lo).to_numpy() for c in ("a", "b")))
            else:
                held[2] += [tuple(_unpack_pairs(x)[:2]) for x in batch.column("bitmaps").slice(lo, hi - lo).to_pylist()]
    if shard is not None:
        yield made()


def _pack_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs of words' ids, sorted, with their numbers."""
    return pack_numbers(np.diff(a, prepend=0), b, n)


def _unpack_pairs(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, b, n = unpack_numbers(packed)
    return np.cumsum(steps, dtype=np.int64), b.astype(np.int64), n.astype(np.int64)


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.diff(key, prepend=np.uint64(0)) != 0)
    if len(key) and key[0] == 0:
        heads = np.concatenate([np.zeros(1, np.int64), heads])
    return key[heads], np.add.reduceat(n[order], heads) if len(heads) else n[:0]


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair of ids, both below 2**32, as one number."""
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def _pairs(buckets: int):
    """A shard's pairs in packets, one for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for shard, own in _shards(batches, False):
            found = list(own.all_pairs())
            if not found:
                continue
            key, n = _sums(np.concatenate([_key(a, b) for a, b, _ in found]), np.concatenate([x[2] for x in found]))
            bucket = mix(key) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1)).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=False):
                at = order[lo:hi]
                yield int(bucket[at[0]]), shard, _pack_pairs(*_halves(key[at]), n[at])

    schema = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("packet", pa.binary())])
    return lean(lambda batches: batches_of(run(batches), schema, 200))


def _halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sum_pairs(least: int):
    """Of packets sorted by bucket: frequent pairs with their sums, in packets without a shard, and those that each shard has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        now = None

        def frequent() -> Iterator[tuple]:
            if not held:
                return
            key, n = _sums(np.concatenate([k for _, k, _ in held]), np.concatenate([n for *_, n in held]))
            key, n = key[n >= least], n[n >= least]
            for lo in range(0, len(key), 100_000):
                yield None, _pack_pairs(*_halves(key[lo : lo + 100_000]), n[lo : lo + 100_000])
            for shard, own, counts in held:
                ok = np.isin(own, key, assume_unique=True)
                if ok.any():
                    yield shard, _pack_pairs(*_halves(own[ok]), counts[ok])

        for batch in batches:
            for bucket, shard, packet in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from frequent()
                    now, held = bucket, []
                a, b, n = _unpack_pairs(packet)
                held.append((shard, _key(a, b), n))
        yield from frequent()

    schema = pa.schema([("shard", pa.int64()), ("packet", pa.binary())])
    return lean(lambda batches: batches_of(run(batches), schema, 200))


def _plain_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packet in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpack_pairs(packet)], names=["a", "b", "f"])


def _phrases(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(f"w{i}" for i in range(longest)), "n"]
        for _, own in _shards(batches, True):
            for words, n in own.phrases(longest):
                none = [pa.nulls(len(n), pa.int64())] * (longest - len(words))
                yield pa.RecordBatch.from_arrays([*map(pa.array, words), *none, pa.array(n)], names=names)

    return lean(run)


def frequent_phrases(docs: DataFrame, work: Work, least: int, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, f, id), frequent phrases of all lengths (p, f) with p their words' ids, and (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    index = work.save(texts.mapInArrow(_make_shards(SHARD_WORDS), _index), "index")
    words = index.where("no IS NOT NULL").select("shard", "lang", "no", "word", "n")
    sizes = work.save(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    frequent = work.save(number_rows(work, frequent, [], ["lang", "word"], "id", "numbered"), "words")
    bitmaps = index.where("bitmaps IS NOT NULL").select("shard", F.lit(0).alias("kind"), "bitmaps")
    known = words.join(frequent.select("lang", "word", "id"), ["lang", "word"])
    known = work.save(known.select("shard", F.lit(1).alias("kind"), F.col("no").cast("long").alias("a"), F.col("id").alias("b")), "known")

    def by_shard(*rows: DataFrame) -> DataFrame:
        both = bitmaps
        for more in rows:
            both = both.unionByName(more, allowMissingColumns=True)
        return both.repartition("shard").sortWithinPartitions("shard", "kind")

    buckets = max(16, (sizes.agg(F.sum("n")).collect()[0][0] or 0) // BUCKET_WORDS)
    packets = by_shard(known).mapInArrow(_pairs(buckets), "bucket long, shard long, packet binary")
    packets = packets.repartition("bucket").sortWithinPartitions("bucket")
    pairs = work.save(packets.mapInArrow(_sum_pairs(least), "shard long, packet binary"), "pairs")
    both = pairs.where("shard IS NULL").select("packet").mapInArrow(lean(_plain_pairs), "a long, b long, f long")
    back = pairs.where("shard IS NOT NULL").select("shard", F.lit(2).alias("kind"), F.col("packet").alias("bitmaps"))
    names = [f"w{i}" for i in range(longest)]
    grown = by_shard(known, back).mapInArrow(_phrases(longest), ", ".join(f"{c} long" for c in [*names, "n"]))
    grown = grown.groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least).select(F.array_compact(F.array(*names)).alias("p"), "f")
    of_one, of_two = frequent.select(F.array("id").alias("p"), "f"), both.select(F.array("a", "b").alias("p"), "f")
    phrases = work.save(of_one.union(of_two).union(grown) if longest > 2 else of_one.union(of_two), "phrases")
    work.drop("index", "known", "pairs", "numbered")
    return frequent, phrases, sizes


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, first: int = 2000, covered_percent: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by score.

    Phrases have 2 to ``longest`` words within a piece and occur ``least`` times at least, overlaps included. A cut
    leaves two parts that occur l and r times and scores floor(2000000 a / (l + r)); the lowest score counts, of
    equal ones the shortest first part. Phrases inside a longer one go that has ``covered_percent`` of their
    occurrences. Sums are exact, products are decimals. Equal scores are told apart by a, then by the phrase's
    bytes. A null language is ``und``, a null or empty text has no words; repeated rows count each; a text of any
    length is read in stretches; other columns are left aside; an empty table gives an empty one.
    """
    work = Work(docs.sparkSession, "collocations")
    frequent, phrases, sizes = frequent_phrases(docs, work, least, longest)
    candidates = phrases.where(F.size("p") > 1).withColumnRenamed("f", "a")
    k = F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k")
    cuts = candidates.select("p", "a", k).select("*", F.expr("slice(p, 1, k)").alias("head"), F.expr("slice(p, k + 1, size(p))").alias("tail"))
    cuts = cuts.join(phrases.select(F.col("p").alias("head"), F.col("f").alias("l")), "head").join(phrases.select(F.col("p").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr("CAST(a AS DECIMAL(31,0)) * 2000000 DIV (l + r)").alias("score")
    best = cuts.select("p", F.struct(score, "k", "a", "l", "r").alias("cut")).groupBy("p").agg(F.min("cut").alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(p) - 1), m -> transform(sequence(1, size(p) - m + 1), i -> slice(p, i, m))))")
    longer = candidates.where(F.size("p") > 2).select(F.explode(inner).alias("p"), F.col("a").alias("longer")).groupBy("p").agg(F.max("longer").alias("longer"))
    decimal = "decimal(31,0)"
    covered = F.col("longer").cast(decimal) * 100 >= F.col("cut.a").cast(decimal) * covered_percent
    kept = best.join(longer, "p", "left").where(F.coalesce(~covered, F.lit(True))).select("p", "cut")
    words = kept.select("p", F.posexplode("p").alias("at", "id")).join(frequent.select("id", "lang", "word"), "id")
    named = words.groupBy("p").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))  # as many words as a phrase has
    named = named.select("p", "lang", F.concat_ws(" ", "words.word").alias("phrase"))
    ranked = kept.join(named, "p").select("lang", "phrase", "cut.*").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= first).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations in all documents; odd rows as ``collocations`` states them."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, w[i : i + m - 1] AS p, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded), (SELECT unnest([1, 2, 3, 4]) AS m)
  WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, c.k, h.f AS l, t.f AS r, (c.f::HUGEINT * 2000000) // (h.f + t.f) AS score
  FROM (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM phrases WHERE len(p) > 1) c
  JOIN phrases h ON h.lang = c.lang AND h.p = c.p[1 : c.k]
  JOIN phrases t ON t.lang = c.lang AND t.p = c.p[c.k + 1 : len(c.p)]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, p[i : i + m - 1] AS p, max(f) AS longer
  FROM (SELECT lang, p, f, unnest(range(1, len(p))) AS i FROM phrases WHERE len(p) > 2), (SELECT unnest([2, 3]) AS m)
  WHERE i + m - 1 <= len(p) AND m < len(p) GROUP BY ALL),
kept AS (
  SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score FROM best b
  LEFT JOIN inner_ i ON i.lang = b.lang AND i.p = b.p
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
