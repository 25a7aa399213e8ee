"""Quality rules: does a document's make-up diverge from its language's?

Two histograms of every language are gathered over all documents: characters by class, and plain words (A-Z in lower case,
marks taken for spaces) by the language's common words (those that make up at least 1/300 of its words, so at most 300) with one bin for
all others. A document's own histograms are held against them by the Jensen-Shannon distance (the square
root of the divergence in bits: 0 for equal shapes, 1 for disjoint ones). Chance alone moves a short text's
histogram, so texts under a minimum length aren't judged, and the word limit shrinks with the length.

Every language of at least 30,000 words has a reference, whatever else the table holds: there a common word
stands 100 times or more. With fewer, chance alone moves the reference (one of 10,000 words drops some 5 % of
the documents that a full one keeps), so documents of such a language, which are never held against a foreign
reference, pass the divergence rule.
Documents whose language is null are held against every reference, and the nearest counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import SPACE, Chunk, Work, batches_of, chunks, lean, mix, sliced

EDGES = ".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "space", "line", "mark", "symbol", "other")
_symbols = "#*$%&|<>"
_schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"
_arrow = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


@dataclass(frozen=True)
class Limits:
    """The rules' parameters."""

    least_words: int = 50
    most_repeated_percent: int = 50
    least_chars_judged: int = 200
    least_words_judged: int = 50
    most_char_distance: float = 0.32
    most_word_distance: float = 0.14
    word_distance_by_length: float = 2.2
    common_share: int = 300
    least_reference_words: int = 30_000


def _class_table() -> np.ndarray:
    """The class of a character by its first UTF-8 byte; 8, past the last class, for bytes that continue one."""
    table = np.full(256, CLASSES.index("other"))
    table[0x80:0xC0] = len(CLASSES)
    for i in range(128):
        c = chr(i)
        table[i] = CLASSES.index("lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if c == " " else "line" if c in "\n\r\t\v\f" else "mark" if c in EDGES else "symbol")
    return table


#: Plain words: A-Z in lower case, marks taken for spaces.
PLAIN = bytes(0x20 if chr(i) in EDGES else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
_table = _class_table()
_is_symbol = np.isin(np.arange(256), [ord(c) for c in _symbols])


def class_counts(chunk: Chunk) -> np.ndarray:
    """For each text of a chunk, its characters by class."""
    n, k = len(chunk), len(CLASSES) + 1
    owner = np.repeat(np.arange(n) * k, np.diff(chunk.offsets))
    return np.bincount(owner + _table[chunk.data], minlength=n * k).reshape(n, k)[:, :-1]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values; empty ones give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def repeated_words(chunk: Chunk, size: int = 3) -> np.ndarray:
    """For each text, the words inside any 3-word window that the text has twice or more."""
    windows, at, owner = chunk.windows(size)
    with np.errstate(over="ignore"):
        keys = mix(windows ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(chunk.hashes), bool)
    for j in range(size):
        covered[at[twice] + j] = True
    return sums(covered, chunk.first)


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; an empty one is at 0."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    total = sum((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum() for a in (p, q))
    return float(np.sqrt(max(0.0, total / 2)))


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, key, n): how often each language has each character class (kind c) and plain word (kind w)."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))

        def held() -> Iterator[tuple]:
            for lang, counter in words.items():
                yield from ((lang, "w", w.decode("utf-8", "replace"), n) for w, n in counter.items())
            words.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for chunk in chunks(batch.column(1)):
                of_classes = class_counts(chunk)
                for lang in set(langs[chunk.row : chunk.row + len(chunk)]):
                    classes[lang] += of_classes[langs[chunk.row : chunk.row + len(chunk)] == lang].sum(axis=0)
            for chunk in chunks(batch.column(1), PLAIN):
                own = langs[chunk.row : chunk.row + len(chunk)]
                data = chunk.data.tobytes()
                for lang in set(own):
                    at = np.flatnonzero((own == lang)[chunk.text_of_word()])
                    _, first, n = np.unique(chunk.hashes[at], return_index=True, return_counts=True)
                    counter = words[lang]
                    for a, b, k in zip(chunk.starts[at[first]].tolist(), chunk.ends[at[first]].tolist(), n.tolist(), strict=True):
                        counter[data[a:b]] += k
                if sum(map(len, words.values())) > 150_000:
                    yield from batches_of(held(), schema, 10_000)
        yield from batches_of(held(), schema, 10_000)
        yield from batches_of(((lang, "c", CLASSES[i], int(n)) for lang, c in classes.items() for i, n in enumerate(c)), schema)

    found = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(lean(count), "lang string, kind string, key string, n long")
    return found.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, limits: Limits = Limits()) -> dict[str, tuple[dict[str, int], np.ndarray, np.ndarray]]:
    """By language: the common words' places in the word histogram, that histogram, and the one of character classes.

    A language takes a row of 300 words at most, some 10 KB, and so many come to the driver as there are languages
    of ``least_reference_words``.
    """
    work = Work(docs.sparkSession, "quality")
    counts = work.save(language_counts(docs), "counts")
    of_lang = counts.where("kind = 'w'").groupBy("lang").agg(F.sum("n").alias("of_lang"))
    kept = of_lang.where(F.col("of_lang") >= limits.least_reference_words)  # a row for each language that has a reference
    found = counts.join(F.broadcast(kept), "lang").where(f"kind = 'c' OR (key <> '' AND n * {limits.common_share} >= of_lang)")
    rows = found.groupBy("lang", "of_lang").agg(F.collect_list(F.struct("kind", "key", "n")).alias("found")).collect()
    work.drop("counts")
    out = {}
    for lang, of_lang, own in sorted(rows):
        common = sorted((r.key, r.n) for r in own if r.kind == "w")
        of_classes = {r.key: r.n for r in own if r.kind == "c"}
        rest = of_lang - sum(n for _, n in common)
        out[lang] = ({w: i for i, (w, _) in enumerate(common)}, np.array([*(n for _, n in common), rest], float), np.array([of_classes.get(c, 0) for c in CLASSES], float))
    return out


class _Bins:
    """The word bins of a language, found by the words' hashes."""

    def __init__(self, common: dict[str, int]):
        words = sorted(common, key=common.get)
        hashes = next(chunks(pa.array([" ".join(words)]))).hashes if words else np.empty(0, np.uint64)
        self.order = np.argsort(hashes)
        self.sorted, self.n = hashes[self.order], len(words)

    def histogram(self, hashes: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.array([len(hashes)])
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.n - 1)
        return np.bincount(np.where(self.sorted[at] == hashes, self.order[at], self.n), minlength=self.n + 1)


class _Rules:
    """Verdicts on a batch's texts, one for each row and in order."""

    def __init__(self, refs: dict, limits: Limits):
        self.refs, self.limits = refs, limits
        self.bins: dict[str, _Bins] = {}

    def bins_of(self, lang: str) -> _Bins:
        if lang not in self.bins:
            self.bins[lang] = _Bins(self.refs[lang][0])
        return self.bins[lang]

    def __call__(self, langs: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        refs, limits, langs = self.refs, self.limits, langs.to_pylist()
        for chunk, low in zip(chunks(texts), chunks(texts, PLAIN), strict=True):
            of_classes = class_counts(chunk)
            n_words, n_repeat = np.diff(chunk.first).tolist(), repeated_words(chunk).tolist()
            n_symbols = sums(_is_symbol[chunk.data], chunk.offsets).tolist()
            n_chars = sums(~SPACE[chunk.data] & (_table[chunk.data] < len(CLASSES)), chunk.offsets).tolist()
            for i, n in enumerate(n_words):
                lang = langs[chunk.row + i]
                failed = n < limits.least_words or 100 * n_repeat[i] > limits.most_repeated_percent * n
                against = list(refs) if lang is None else [lang] if lang in refs else []
                of_chars = of_words = None
                if of_classes[i].sum() >= limits.least_chars_judged and against:
                    of_chars = min(distance(of_classes[i], refs[x][2]) for x in against)
                own = low.hashes[low.first[i] : low.first[i + 1]]
                if len(own) >= limits.least_words_judged and against:
                    of_words = min(distance(self.bins_of(x).histogram(own), refs[x][1]) for x in against)
                far = (of_chars or 0) > limits.most_char_distance or (of_words or 0) > limits.most_word_distance + limits.word_distance_by_length / max(len(own), 1) ** 0.5
                yield n, n_chars[i], n_symbols[i], dup_lines(chunk.bytes_of(i)), n_repeat[i], of_chars, of_words, failed, not failed and not far


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A verdict on every row of ``docs`` (doc_id, text, lang; other columns are left aside).

    A null text counts as an empty one: no words, so base_failed. Rows that repeat a doc_id are judged each by
    itself, a null doc_id stays null. A very long text is hashed in stretches. Common words are all
    above a share, so no ties are broken. An empty table gives an empty result. Without a reference to be held against the
    base rules alone decide. Distances of such texts and of those under the least lengths are null and don't count
    against them.
    """
    refs = references(docs, limits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rules = _Rules(refs, limits)
        for part in (x for batch in batches for x in sliced(batch)):
            for doc_id, verdict in zip(part.column(0).to_pylist(), rules(part.column(1), part.column(2)), strict=True):
                yield doc_id, *verdict

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(lean(lambda b: batches_of(rows(b), _arrow)), _schema)


def passing(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` with a good verdict, all their columns kept."""
    refs = references(docs, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _Rules(refs, limits)
        for part in (x for batch in batches for x in sliced(batch)):
            verdicts = rules(part.column("lang").cast(pa.string()), part.column("text").cast(pa.string()))
            yield part.filter(pa.array([v[-1] for v in verdicts], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("char_distance", "word_distance")
