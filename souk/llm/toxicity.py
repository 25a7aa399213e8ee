"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

Words are compared by the subsequences of three letters that they share, however far apart the letters
stand: each occurrence weighs DECAY to the power of the stretch that it spans (at most SPAN letters), so
gapped and inserted letters cost similarity but don't hide a word. Before, a word is lowered, marks inside it
go, digits that pass for letters are read as these, and what white space or marks pull apart is joined as well:
letters spelled out one by one, and neighbouring fragments of up to SHORT letters.

The kernel of two words is the cosine c of their subsequences' weights, sharpened to exp(2 * SHARP * (c - 1)).
It is approximated from landmarks (Nyström): a word's features are its kernels with some 160 landmark words,
whitened by the landmarks' own kernel matrix, and a linear machine is trained on them.

Labels are of documents: a toxic one is a bag of words of which some are toxic, a clean one has none (the
multiple-instance machine of Andrews et al. 2003). Each round takes the worst word of every toxic training
document (of those that are ten times rarer in clean ones), words that hardly any clean one has, and the worst ones of the clean documents, and trains anew. A document's score is the logistic
value, fitted on the training documents, of its worst word's margin.

Training reads a bounded sample of labelled rows, all their words: TOXIC and CLEAN documents, those whose doc_id
hashes least. Scoring reads every word of every text. The kernel works on words and joined fragments, not on
whole sentences: an insult is a word or two, and in a sentence's kernel the other hundred words drown it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import batches_of, lean, small_batches

TOXIC, CLEAN = 1500, 3000
DECAY, SPAN, LONGEST, SHORT = 0.7, 8, 24, 3
SHARP, LANDMARKS, ROUNDS = 2.0, 160, 4
_LETTERS = 64
_read_as = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_spelled = re.compile(r"(?<!\S)\w(?:[\W_]+\w){2,}(?!\w)")
_fragments = re.compile(r"(?<!\S)(?=([^\W\d_]{1,%d})\s+([^\W\d_]{1,%d})(?!\S))" % (SHORT, SHORT))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tokens(text: str) -> set[str]:
    """The distinct words of a text, lowered; letters spelled out one by one, and two short fragments, count as a word too."""
    low = text.lower()
    found = set(low.split())
    found.update("".join(c for c in x if c.isalnum()) for x in _spelled.findall(low))
    found.update(map("".join, set(_fragments.findall(low))))
    return found


def letters(word: str) -> str:
    if not word.isalpha():
        word = "".join(c for c in word.translate(_read_as) if c.isalpha())
    return word


def pieces(word: str) -> list[str]:
    """A word's letters; overlapping stretches of a very long one."""
    word = letters(word)
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length as numbers under 64: a-z have their own, others share the rest."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(words), -1)
    plain = (points >= 97) & (points <= 122)
    return np.where(plain, points - 97, 26 + points % (_LETTERS - 26))


_places: dict[int, tuple] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of three letters in words of n, and their weights."""
    if n not in _places:
        at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
        i, j, k = np.array(at).T
        _places[n] = i, j, k, (DECAY ** (k - i + 1.0)).astype(np.float32)
    return _places[n]


def subsequences(words: list[str], at_once: int = 4000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which words, their subsequences' numbers, the weights) for words of one length at a time; from 3 letters on."""
    by_length: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by_length.setdefault(len(w), []).append(at)
    for n, own in by_length.items():
        if n >= 3:
            i, j, k, weight = _triples(n)
            for lo in range(0, len(own), at_once):
                part = own[lo : lo + at_once]
                codes = _codes([words[x] for x in part])
                yield np.array(part), (codes[:, i] * _LETTERS + codes[:, j]) * _LETTERS + codes[:, k], weight


def _norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The lengths of words' vectors of subsequence weights, where a subsequence may occur more than once."""
    order = np.argsort(codes, axis=1)
    codes, total = np.take_along_axis(codes, order, 1), np.cumsum(weight[order], axis=1, dtype=np.float64)
    last = np.ones(codes.shape, bool)
    last[:, :-1] = codes[:, 1:] != codes[:, :-1]
    ends = np.where(last, total, 0.0)
    before = np.zeros_like(ends)
    before[:, 1:] = np.maximum.accumulate(ends, axis=1)[:, :-1]
    return np.sqrt((np.where(last, total - before, 0.0) ** 2).sum(axis=1))


class Landmarks:
    """Words whose kernels with a word are the word's features."""

    def __init__(self, words: list[str]):
        self.words = words
        found = list(subsequences(words))
        used = np.unique(np.concatenate([codes.reshape(-1) for _, codes, _ in found])) if found else np.empty(0, np.int64)
        self.row = np.zeros(_LETTERS**3, np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.weights = np.zeros((len(used) + 1, len(words)), np.float32)
        for at, codes, weight in found:
            np.add.at(self.weights, (self.row[codes], np.broadcast_to(at[:, None], codes.shape)), np.broadcast_to(weight / _norms(codes, weight)[:, None], codes.shape))

    def kernels(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which words, their kernels with all landmarks)."""
        for at, codes, weight in subsequences(words):
            rows = self.row[codes]
            some = rows.any(axis=1)
            at, codes, rows = at[some], codes[some], rows[some]
            if len(at):
                shared = np.zeros((len(at), len(self.words)), np.float32)
                for t, w in enumerate(weight):
                    shared += w * self.weights[rows[:, t]]
                yield at, np.exp(2 * SHARP * (shared / _norms(codes, weight)[:, None].astype(np.float32) - 1))

    def features(self, words: list[str]) -> np.ndarray:
        out = np.full((len(words), len(self.words)), math.exp(-2 * SHARP), np.float32)
        for at, k in self.kernels(words):
            out[at] = k
        return out


def margins(words: list[str], landmarks: Landmarks, beta: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(words), bias + math.exp(-2 * SHARP) * float(beta.sum()))
    for at, k in landmarks.kernels(words):
        out[at] = k @ beta + bias
    return out


def train_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, strength: float = 1e-5) -> np.ndarray:
    """Weights and bias of least squared hinge loss, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = strength * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(30):
        inside = y * (x @ w) < 1
        own, c = x[inside], weight[inside, None]
        step = np.linalg.solve(own.T @ (own * c) + ridge, own.T @ (c[:, 0] * y[inside]))
        if np.abs(step - w).max() < 1e-6:
            break
        w = step
    return w


@dataclass
class Model:
    """The machine (a coefficient for each landmark), and what makes the worst word's margin a score."""

    landmarks: Landmarks
    beta: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        return margins(words, self.landmarks, self.beta, self.bias)

    def score(self, worst: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * worst + self.offset))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y in 0, 1)."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.05 * (w - [1.0, 0.0])
        w = w - np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-6)[:, None]) + 0.05 * np.eye(2), grad)
    return float(w[0]), float(w[1])


def variants(word: str) -> list[str]:
    """A word with a letter doubled or another one put in."""
    return [word[:i] + word[i - 1] + word[i:] for i in range(1, len(word) + 1)] + [word[:i] + "x" + word[i:] for i in range(1, len(word))]


def train(toxic: list[list[str]], clean: list[list[str]]) -> Model | None:
    """From bags of words of toxic and of clean documents."""
    of_toxic, of_clean = Counter(w for b in toxic for w in set(b)), Counter(w for b in clean for w in set(b))
    n_toxic, n_clean = len(toxic), len(clean)
    telling = {w: n * math.log((n + 0.1) / n_toxic / ((of_clean[w] + 0.5) / n_clean)) for w, n in of_toxic.items()}
    ranked = sorted((w for w in telling if len(w) >= 3), key=lambda w: (-telling[w], w))
    bad = ranked[: LANDMARKS // 2]
    good = sorted((w for w in of_clean if len(w) >= 3 and w not in set(bad)), key=lambda w: (-of_clean[w], w))[: LANDMARKS // 4]
    vocabulary = sorted(of_toxic.keys() | of_clean.keys())
    place = {w: i for i, w in enumerate(vocabulary)}
    clean_words = np.array(sorted(place[w] for w in of_clean), np.int64)
    rare_in_clean = {w for w, n in of_toxic.items() if of_clean[w] / n_clean <= 0.1 * n / n_toxic}
    bags = [np.array([place[w] for w in b if w in rare_in_clean], np.int64) for b in toxic]
    value = np.array([telling.get(w, -1.0) for w in vocabulary])
    hard: set[int] = set()
    sure = Counter({place[w]: n for w, n in of_toxic.items() if n > 2 and len(w) >= 3 and n / n_toxic >= 20 * of_clean[w] / n_clean})
    model = None
    for turn in range(ROUNDS):
        positive = Counter(int(b[value[b].argmax()]) for b in bags if len(b) and value[b].max() > (0 if turn == 0 else -1))
        if not positive:
            break
        positive |= sure
        marks = Landmarks(bad + [w for w in good if w not in set(bad)])
        kernel = marks.features(marks.words).astype(float)
        values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        keep = values > 1e-5 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        hard.update(clean_words[np.argsort(-value[clean_words], kind="stable")[:2000]].tolist())
        rest = clean_words[:: max(1, len(clean_words) // 8000)].tolist()
        bent = [(x, n / 4) for i, n in positive.items() if n > 2 and not of_clean[vocabulary[i]] for x in variants(vocabulary[i]) if x not in of_clean]
        negative = [*sorted(hard), *rest]
        x = marks.features([vocabulary[i] for i in positive] + [x for x, _ in bent] + [vocabulary[i] for i in negative]).astype(float) @ whiten
        y = np.array([1.0] * (len(positive) + len(bent)) + [-1.0] * len(negative))
        c = np.array([*(min(n, 20) for n in positive.values()), *(min(n, 20) / 2 for _, n in bent), *(float(min(of_clean[vocabulary[i]], 20)) for i in negative)])
        c /= c[y > 0].sum()  # a word counts as often as documents have it: the cost of a wrong verdict on it
        w = train_linear(x, y, c)
        model = Model(marks, whiten @ w[:-1], float(w[-1]), 1.0, 0.0)
        value = model.margins(vocabulary)
        good = [vocabulary[i] for i in clean_words[np.argsort(-value[clean_words], kind="stable")[: LANDMARKS // 2]]]
    if model is not None:
        floor = float(model.margins([""])[0])
        top = lambda words: max((value[place[w]] for w in words), default=floor)
        model.slope, model.offset = _logistic(np.array([top(b) for b in toxic] + [top(b) for b in clean]), np.array([1.0] * n_toxic + [0.0] * n_clean))
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of a bounded sample of labelled rows that aren't held out; None without both labels."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in ((1, TOXIC), (0, CLEAN))]
    schema = pa.schema([("toxic", pa.int64()), ("words", pa.list_(pa.string()))])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield toxic, sorted({p for w in tokens(text or "") for p in pieces(w) if len(p) >= 3})

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id")
    rows = chosen.select(F.col("toxic").cast("long"), "text").mapInArrow(lean(lambda b: batches_of(bags(b), schema, 200)), "toxic long, words array<string>").toArrow()
    once: dict[str, str] = {}  # of equal words one stays in memory
    by_label: tuple[list, list] = ([], [])
    for label, words in zip(rows.column(0), rows.column(1), strict=True):
        by_label[label.as_py()].append([once.setdefault(w, w) for w in words.as_py()])
    clean, toxic = by_label
    return train(toxic, clean) if toxic and clean else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text is an empty one; texts without words have the score of a word unlike any, a very long word is
    taken in overlapping stretches; a very long text is read word by word, and of its words the worst decides, whichever of
    equal ones. Rows that repeat a doc_id are scored each, a null doc_id stays null and isn't held out. Without a model (no labels of both
    kinds to learn from) all scores are 0. Other columns are left aside; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        floor = float(model.margins([""])[0]) if model else 0.0
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo in range(0, len(texts), 500):
                if len(cache) > 500_000:
                    cache.clear()
                bags = [tokens(t or "") for t in texts[lo : lo + 500]]
                scores = [0.0] * len(bags)
                if model is not None:
                    new = list(set().union(*bags) - cache.keys())
                    parts = [(w, p) for w in new for p in pieces(w)]
                    cache.update(dict.fromkeys(new, floor))
                    for (w, _), m in zip(parts, model.margins([p for _, p in parts]).tolist(), strict=True):
                        if m > cache[w]:
                            cache[w] = m
                    scores = [model.score(max(map(cache.__getitem__, b), default=floor)) for b in bags]
                part = batch.slice(lo, len(bags))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=schema)

    columns = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return columns.mapInArrow(lean(rows), "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
