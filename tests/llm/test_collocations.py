"""Collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from souk.llm import collocations
from souk.llm.collocations import Shard, Words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least, longest, first):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:first])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "Ünï", "a", "b", "c", "ÉÉ", "x-y", " ", "z\x1c", *(f"w{i}" for i in range(20))]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!? "]
    rows = [(i, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"])) for i in range(300)]
    rows += [(400 + i, "all of the same phrase again and again, all of the same", "en") for i in range(40)]
    rows += [(None, "a a a a a a", "en"), (500, None, "en"), (501, "", "xx"), (502, " .,. ", None), (503, "b " * 30_000, "de"), (503, "b " * 30_000, "de"), (504, "y" * 4000 + " " + "c " * 50, "de"), (505, "a", "none")]
    return rows


@pytest.mark.parametrize(("least", "longest", "first"), [(30, 4, 2000), (3, 4, 50), (5, 2, 10)])
def test_collocations(spark, rows, least, longest, first, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 700)  # many shards
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id long, text string, lang string, word string, shard int, n int")
    got = collocations.collocations(docs, least, longest, first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, first)
    assert collocations.collocations(docs.limit(0), least, longest, first).collect() == []


def test_words_and_bitmaps(rows, monkeypatch):
    monkeypatch.setattr(collocations, "_STRETCH", 50)
    monkeypatch.setattr(collocations, "AT_ONCE", 40)
    some = [t for _, t, _ in rows][:120]
    own = Words()
    own.add(pa.array(some[:60]))
    own.add(pa.array(["skipped", *some[60:]]).slice(1))
    words, counts, packed = own.index()
    want = [p for t in some for p in pieces(t)]
    assert dict(zip(words.to_pylist(), counts.tolist(), strict=True)) == Counter(w for p in want for w in p)
    names = words.to_pylist()
    shard = Shard(packed, np.arange(len(names)), np.arange(len(names)) * 7)
    pairs: Counter = Counter()
    for a, b, n in shard.all_pairs():
        for x, y, m in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
            pairs[names[x // 7], names[y // 7]] += m
    assert pairs == Counter(p[i : i + 2] for p in map(tuple, want) for i in range(len(p) - 1))
    keys = np.array([(names.index(a) * 7, names.index(b) * 7) for a, b in pairs]).T
    longer: Counter = Counter()
    for ids, n in Shard(packed, np.arange(len(names)), np.arange(len(names)) * 7, keys).phrases(4):
        for *p, m in zip(*(x.tolist() for x in ids), n.tolist(), strict=True):
            longer[tuple(names[x // 7] for x in p)] += m
    assert longer == Counter(p[i : i + m] for m in (3, 4) for p in map(tuple, want) for i in range(len(p) - m + 1))
