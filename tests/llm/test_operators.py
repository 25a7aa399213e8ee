"""The training-data operators against brute force on small tables with every odd row."""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions

from souk.llm import bagminhash, common, decontam, huffman, lines, packing, quality, sharding, substring, tokens, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, windows int, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(150)]
    rows: list[tuple] = [(None, "null id " * 20, "en"), (1, None, "en"), (2, "", None), (3, " \n ", "en"), (4, "a b c", "xx"), (5, "a b c", "en"), (6, " ".join(base), "en"), (6, " ".join(base), "en"), (7, " ".join(base), "fr")]
    for i in range(12):
        near = list(base)
        for _ in range(rng.randint(0, 8)):
            near[rng.randrange(150)] = f"z{rng.randrange(99)}"
        rows.append((10 + i, " ".join(near), "en"))
    for i in range(25):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12)))
        rows.append((30 + i, text + ("\nthe same last line of all texts\nand one more" if i % 3 else ""), rng.choice(["en", "fr", None])))
    rows += [(70, "q " * 60, "en"), (71, "q " * 70, "en"), (72, "long " + "y" * 5000 + " tail", "en"), (73, " ".join(rng.choice(words) for _ in range(20_000)), "en"), (74, "Ünï cödé x  two\tspaces \n\n end ", "de"), (6, "another text of six", "en")]
    return spark.createDataFrame([(i, t, lang, "src", len(t or ""), "r", 1, 2) for i, t, lang in rows], DOCS).cache()


def table(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_words_in_bulk(docs):
    texts = [t for _, t in table(docs)]
    seen: dict[str, int] = {}
    at = 0
    for chunk in common.chunks(pa.array(texts), size=1000):
        for i in range(len(chunk)):
            words = WORD.findall(texts[at] or "")
            hashes = chunk.hashes[chunk.first[i] : chunk.first[i + 1]].tolist()
            assert len(hashes) == len(words)
            assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
            at += 1
    assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_number_rows(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id")
    got = common.number_rows(common.Work(spark, "t"), rows, ["k"], ["id"], "n", "x").collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r.n, r.id))
    assert all([n for n, _ in sorted(v)] == list(range(len(v))) and [i for _, i in sorted(v)] == sorted(i for _, i in v) for v in by.values())


def test_quality(docs):
    def base(text):
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
        own = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(covered)

    got = quality.judge(docs).collect()
    want = sorted((i is not None, i or 0, *base(t)) for i, t in table(docs))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.passing(docs).columns == docs.columns
    assert quality.passing(docs).count() == sum(r.kept for r in got)
    assert quality.judge(docs.limit(0)).count() == 0
    p, q = np.array([1.0, 0.0]), np.array([0.0, 2.0])
    assert quality.distance(p, q) == 1.0 and quality.distance(p, p) == 0.0
    assert abs(quality.distance(np.array([1, 1]), np.array([1, 0])) - 0.5579230452841438) < 1e-12


def test_quality_of_small_languages(spark):
    rng = random.Random(4)

    def text(prefix, n, sizes=60):
        return " ".join(f"{prefix}{int(rng.paretovariate(0.9)) % sizes}" for _ in range(n))

    rows = [(i, text("big", 10_000), "big") for i in range(20)]
    rows += [(100 + i, text("small", 200), "small") for i in range(160)]
    rows += [(300, text("junk", 200), "small"), (301, text("small", 200), None), (302, text("junk", 200), None)]
    rows += [(400 + i, text(f"few{i}x", 60), "few") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.unionByName(docs.where("lang = 'big'").crossJoin(spark.range(19)).drop("id"))  # 4 million words, under 1 % of them small
    limits = quality.Limits(most_repeated_percent=100)
    assert set(quality.references(docs, limits)) == {"big", "small"}  # whatever their share of all words
    kept = {r.doc_id for r in quality.judge(docs, limits).where("kept").collect()}
    assert kept == {i for i, _, _ in rows} - {300, 302}


def test_substring(docs):
    rows = [(i, WORD.findall(t or "")) for i, t in table(docs)]
    first: dict[tuple, int] = {}
    for i, w in rows:
        for p in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, i), i)
    want = []
    for i, w in rows:
        gone = {p + j for p in range(len(w) - 12 if i is not None else 0) if first[tuple(w[p : p + 13])] < i for j in range(13)}
        want.append((str(i), len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring.remove(docs).collect()) == sorted(want)
    assert substring.remove(docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    def shingles(text):
        w = WORD.findall(text)
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])

    rows = table(docs)
    sets = [shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is not None and rows[j][1] is not None:
                both = sum((sets[i] & sets[j]).values())
                all_of = sum((sets[i] | sets[j]).values())
                if rows[i][1] == rows[j][1] or (all_of and both / all_of >= 0.8):
                    parent[root(i)] = root(j)
    name: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[root(i)] = min(name.get(root(i), d), d)
    want = sorted(((str(d), str(name.get(root(i))), d == name.get(root(i)))) for i, (d, _) in enumerate(rows))
    got = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in bagminhash.near_duplicates(docs).collect())
    assert got == want
    assert bagminhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    items, a = rng.integers(0, 2**62, 200).astype(np.uint64), rng.integers(1, 9, 200)
    b = np.maximum(0, a + rng.integers(-3, 4, 200))
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    found = []
    for seed in range(12):
        h, some = common.mix(items + np.uint64(seed)), b > 0
        s = bagminhash.signatures(np.concatenate([h, h[some]]), np.repeat([0, 1], [200, some.sum()]), np.concatenate([a, b[some]]), 2)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - true) < 0.03


def maximal_runs(texts, least=5):
    """By enumeration: which lines (with a word) of each text lie in a run of ``least`` words that an earlier place has too."""
    split = [[tuple(WORD.findall(x)) for x in t.split("\n") if WORD.search(x)] for t in texts]
    seen, gone = defaultdict(set), [[False] * len(v) for v in split]
    for d, v in enumerate(split):
        for i in range(len(v)):
            n = 0
            while i + n < len(v) and tuple(v[i : i + n + 1]) in seen[n]:
                n += 1
            if sum(map(len, v[i : i + n])) >= least:
                gone[d][i : i + n] = [True] * n
            for m in range(len(v) - i):  # from here on the runs that begin here are earlier ones
                seen[m].add(tuple(v[i : i + m + 1]))
    return split, gone


def test_lines(docs):
    split = lambda t: [tuple(WORD.findall(x)) for x in t.split("\n") if WORD.search(x)]
    rows = sorted(table(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    own = [k for k in dict.fromkeys(rows) if k[0] is not None and k[1] is not None]
    # Two texts of one doc_id come in the order of their hashes; these two share no line.
    gone = dict(zip(own, maximal_runs([t for _, t in own])[1], strict=True))
    want = sorted((str(d), len(split(t)) if t is not None else 0, sum(gone.get((d, t), []))) for d, t in rows)
    got = lines.dedup_lines(docs).collect()
    assert sorted((str(r.row.doc_id), r.n_lines, r.n_removed) for r in got) == want
    for r in got:
        if r.kept_text is not None and r.row.doc_id is not None:
            left = [x for x, g in zip(split(r.row.text), gone[r.row.doc_id, r.row.text], strict=True) if not g]
            assert split(r.kept_text) == left
    assert lines.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_maximal_runs(spark, seed):
    """Runs of every length, of short lines, inside one text and across texts."""
    rng = random.Random(seed)
    texts = ["x y\na b\nc d\nz w", "c c\nx y\na b\nc d\nq", "e\ne\ne\ne\ne\ne\ne\ne", "f\nf\nf\nf\ng", "two words\ntwo words\nthree words here", "h i\nj k\n" + "long " * 60, "h i\nj k\n" + "long " * 60]
    runs = [[f"{rng.choice('abcdefgh')} {rng.choice('uv')}"[: rng.choice([1, 3])] for _ in range(rng.randint(1, 40))] for _ in range(8)]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            run = rng.choice(runs)
            i = rng.randrange(len(run))
            parts += run[i : rng.randint(i, len(run) - 1) + 1]
        texts.append("\n".join(parts))
    got = {r.row.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    split, gone = maximal_runs(texts)
    assert sum(gone[1]) == 3 and sum(gone[5]) == 0
    for d, (v, g) in enumerate(zip(split, gone, strict=True)):
        assert [tuple(x.split()) for x in got[d].kept_text.split("\n") if x.strip()] == [x for x, y in zip(v, g, strict=True) if not y]
        assert (got[d].n_removed, got[d].n_runs) == (sum(g), sum(y and not (i and g[i - 1]) for i, y in enumerate(g)))


def test_nearest_earlier_by_ranges():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 40)
        at, lcp = rng.sample(range(100), n), [0] + [rng.choice([0, 1, 2, 3, 9]) for _ in range(n - 1)]
        want = [max([0, *(min(lcp[min(s, t) + 1 : max(s, t) + 1]) for s in range(n) if at[s] < at[t])]) for t in range(n)]
        longest, opened, cuts = [], [], sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 5))))
        for lo, hi in zip([0, *cuts], [*cuts, n], strict=True):
            part, unsettled = lines.nearest_earlier(at[lo:hi], lcp[lo:hi])
            longest += part
            opened += [lo + t for t in unsettled]
        between = [min(lcp[max(lo + 1, 0) : hi + 1], default=0) for lo, hi in zip([-1, *opened[:-1]], opened, strict=True)]
        rest, _ = lines.nearest_earlier([at[t] for t in opened], between)
        for t, more in zip(opened, rest, strict=True):
            longest[t] = max(longest[t], more)
        assert longest == want


def test_a_common_line_leaves_few_open():
    """Places of one line with nothing else in common, in ascending order: whatever their number, a range leaves two."""
    n = 20_000
    assert lines.nearest_earlier(list(range(0, 2 * n, 2)), [1] * n) == ([0, *[1] * (n - 1)], [0, n - 1])
    longest, kept = lines.nearest_earlier(list(range(2 * n, 0, -2)), [1] * n)
    assert longest == [*[1] * (n - 1), 0] and len(kept) <= 2


def test_common_line_and_unique_ones(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "concat('one common line of six words\n', 'own ', id, ' a b c\n', 'u', id % 1000, ' v w x y') AS text")
    got = {r.row.doc_id: r.n_removed for r in lines.dedup_lines(rows).select("row", "n_removed").collect()}
    assert got == {i: (i > 0) + (i >= 1000) for i in range(4000)}
    work = common.Work(spark, "lines")
    array = spark.range(4000).selectExpr("id AS rank", "id * 3 AS at", "0L AS line", "1L AS lcp")
    assert lines.longest_earlier(work, array).where("lines = 1").count() == 3999
    assert spark.read.parquet(f"{work.uri}/ranges").where("open").count() <= 3 * spark.read.parquet(f"{work.uri}/ranges").rdd.getNumPartitions() + 3


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "w1 w2"), (2, None), (3, "!!"), (4, "the same last LINE of all texts and one more thing"), (5, "A, b c"), (5, "a b"), (None, "tail")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(lower))
    windows = defaultdict(set)
    for r in items.collect():
        w = split(r.text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add("" if r.item_id is None else str(r.item_id))
    want = []
    for d, t in table(docs):
        w, hit, found = split(t), set(), set()
        for k, ids in windows.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit.update(range(s, s + len(k)))
                    found |= ids
        want.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in decontam.contamination(docs, items).collect()) == sorted(want)
    assert not any(r.contaminated for r in decontam.contamination(docs, items.limit(0)).collect())
    assert decontam.contamination(docs.limit(0), items).count() == 0


def test_words_of_every_character(spark):
    text = "".join(chr(c) + "x" * (c % 3) for c in [*range(1, 0x300), 0x7FF, 0x800, 0x2028, 0xD7FF, 0xE000, 0xFEFF, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t in (text, text[:100], "\x7f\x80a\x60{", ""):
        got = spark.createDataFrame([(t,)], "t string").select(decontam.words(functions.col("t"))).collect()[0][0]
        assert got == re.findall(decontam.WORDS, t.translate(lower))


def test_proximity(spark):
    texts = spark.createDataFrame([(1, "x alpha beta gamma"), (2, "alpha y beta z gamma"), (3, "alpha beta"), (4, "gamma beta alpha")], "doc_id long, text string")
    phrases = decontam.item_phrases(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")).select("phrase", "terms")
    index = decontam.Index(texts)
    search = decontam.Search(index, phrases)
    ids = {r.row: r.doc_id for r in index.documents().collect()}
    assert {ids[r.row] for r in search.exact().collect()} == {1}
    assert {ids[r.row] for r in search.proximity(2).collect()} >= {1, 2}
    assert 3 not in {ids[r.row] for r in search.proximity(2).collect()}


def test_proximity_at_the_start(spark):
    texts = spark.createDataFrame([(1, "alpha gamma beta"), (2, "alpha beta x alpha beta"), (3, "x alpha gamma beta")], "doc_id long, text string")
    phrases = decontam.item_phrases(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")).select("phrase", "terms")
    index = decontam.Index(texts)
    search = decontam.Search(index, phrases)
    ids = {r.row: r.doc_id for r in index.documents().collect()}
    assert {(ids[r.row], r.start) for r in search.proximity(2).collect()} == {(1, -1), (3, 0)}
    assert search.exact().count() == 0


def test_one_index_serves_two_benchmarks(spark):
    texts = spark.createDataFrame([(1, "one two three four"), (2, "four three two one"), (3, None), (4, "two three")], "doc_id long, text string")
    index = decontam.Index(texts)
    assert sorted(r.term for r in index.postings.where("term <> ''").collect()) == sorted("one two three four four three two one two three".split())
    assert sorted((r.doc_id, r.n_words) for r in index.documents().collect()) == [(1, 4), (2, 4), (3, 0), (4, 2)]
    ids = {r.row: r.doc_id for r in index.documents().collect()}
    for text, want in (("Two three", {(1, 1), (4, 0)}), ("four, three", {(2, 0)}), ("one five", set())):
        phrases = decontam.item_phrases(spark.createDataFrame([(1, text)], "item_id long, text string")).select("phrase", "terms")
        assert {(ids[r.row], r.start) for r in decontam.Search(index, phrases).exact().collect()} == want


def test_tokens_are_the_librarys(docs):
    from tokenizers import Tokenizer

    own, library = tokens.encoder(tokens.vocabulary_file()), Tokenizer.from_file(tokens.vocabulary_file())
    rng, parts = random.Random(3), ["a", "Ünï", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "²", ".", "!!", "\x85", "\u3000", "中", "\u0301", "don't", "Word", "_", "ʰ"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    for text in mixed + [t or "" for _, t in table(docs)] + ["it's  don't 's", " lead", "trail \n", "a,.b c!! d'e.' f", "ñ ß 123abc 12.5, x's'.", "a\r\nb　c", "<|endoftext|> x<|endoftext|>.", "a\n\n<|endoftext|>b", "a \x85<|endoftext|>\t<|endoftext|>"]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_tokens_of_spaces_and_controls():
    """Everything that Unicode or Python takes for a space or a control character, between letters, marks and digits."""
    import sys
    import unicodedata

    from tokenizers import Tokenizer

    own, library = tokens.encoder(tokens.vocabulary_file()), Tokenizer.from_file(tokens.vocabulary_file())
    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() or unicodedata.category(c) in ("Cc", "Zs", "Zl", "Zp", "Cf")]
    rng = random.Random(6)
    for i in range(30_000):
        others = ["a", "'s", "'ll", "B1", ".", " ", "\n", "é", odd[i % len(odd)], rng.choice(odd), rng.choice("\x1c\x1d\x1e\x1f")]
        text = "".join(rng.choice(others) for _ in range(rng.randint(1, 9)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def _ids(text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokens.vocabulary_file()).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs):
    got = packing.pack(docs, capacity=128).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.piece].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 128
    for d, t in table(docs)[:20]:
        ids = _ids(t, 0)
        pieces = [x for (i, _), rows in by_doc.items() if i == d for x in rows]
        assert any(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    total = sum(r.length for r in got)
    assert total == sum(len(_ids(t, 0)) for _, t in table(docs))
    assert len(by_sequence) <= -(-total // 128) * 1.1 + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_plan():
    rng = random.Random(3)
    for _ in range(40):
        counts = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 200)))
        used, rooms = Counter(), defaultdict(list)
        for length, rank, n, sequence, offset in packing.plan(dict(counts), 64):
            assert rank == used[length]
            used[length] += n
            for i in range(n):
                rooms[sequence + i].append((offset, length))
        assert used == counts
        for places in rooms.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 64
    assert packing.plan({}) == []


def n_sequences(runs):
    return len({sequence + i for _, _, n, sequence, _ in runs for i in range(n)})


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        at = min((r, i) for i, r in enumerate(rooms) if r >= x)[1] if any(r >= x for r in rooms) else len(rooms)
        if at == len(rooms):
            rooms.append(capacity)
        rooms[at] -= x
    return len(rooms)


def fewest(lengths, capacity):
    """The fewest sequences, by trying all."""
    lengths, best = sorted(lengths, reverse=True), best_fit_decreasing(lengths, capacity)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                put(i + 1, [*(r for j, r in enumerate(rooms) if j != rooms.index(room)), room - lengths[i]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def test_packing_takes_few_sequences():
    rng = random.Random(8)
    for make in (lambda: rng.randint(300, 1300), lambda: min(2048, int(rng.lognormvariate(6.5, 0.9)) + 1), lambda: rng.randint(1, 2048), lambda: rng.choice([700, 701, 1030, 340])):
        lengths = [make() for _ in range(1500)]
        assert n_sequences(packing.plan(dict(Counter(lengths)))) <= best_fit_decreasing(lengths, 2048)
    near = 0
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        got, want = n_sequences(packing.plan(dict(Counter(lengths)), 20)), fewest(lengths, 20)
        assert got <= best_fit_decreasing(lengths, 20)
        near += got == want
    assert near >= 58


def test_cut():
    assert [list(packing.cut(n, 4)) for n in (1, 4, 6, 9)] == [[(0, 1)], [(0, 4)], [(0, 2), (2, 4)], [(0, 1), (1, 4), (5, 4)]]


def test_huffman_codes():
    rng = np.random.default_rng(0)
    for n, v in ((0, 1), (1, 1), (5, 3), (1024, 50), (1025, 3000), (50_000, 40_000)):
        ids = np.minimum(rng.zipf(1.2, n), v).astype(np.int64) - 1 if n else np.zeros(0, np.int64)
        counts = np.bincount(ids, minlength=v)
        lengths = huffman.code_lengths(counts)
        assert lengths.max(initial=0) <= huffman.LIMIT and ((lengths > 0) == (counts > 0)).all()
        if (counts > 0).sum() > 1:
            assert abs(sum(2.0 ** -int(x) for x in lengths if x) - 1) < 1e-9
        out = io.BytesIO()
        huffman.write_file(out, [1, None], [n, 0], ids, lengths, huffman.canonical_codes(lengths))
        out.seek(0)
        doc_ids, sizes, back = huffman.read_file(out)
        assert doc_ids == [1, None] and sizes.tolist() == [n, 0] and (back == ids).all()
    assert huffman.code_lengths(np.array([5, 1, 1])).tolist() == [1, 2, 2]


def test_huffman_files(docs):
    got = sorted(huffman.read(*huffman.write(docs)).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((d, zlib.crc32(_ids(t, 2).tobytes())) for d, t in table(docs))
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert huffman.read(*huffman.write(docs.limit(0))).count() == 0


def test_schedule_is_longest_first():
    rng = random.Random(5)
    for turn in range(150):
        most = rng.choice([300, 10**4, 10**7])  # sizes of any magnitude are exact
        sizes = [(s, rng.randint(1, 150 if turn % 2 else 3)) for s in rng.sample(range(1, most), rng.randint(1, 20))]
        k = rng.randint(1, 16)
        heap, want = [(0, i) for i in range(k)], Counter()
        for size, n in sorted(sizes, reverse=True):
            for _ in range(n):
                load, i = heapq.heappop(heap)
                want[size, i] += 1
                heapq.heappush(heap, (load + size, i))
        runs, got, n_of = sharding.schedule(sizes, k), Counter(), dict(sizes)
        for j, (size, rank, i) in enumerate(runs):
            end = runs[j + 1][1] if j + 1 < len(runs) and runs[j + 1][0] == size else n_of[size]
            got[size, i] += end - rank
        assert got == want


def test_sharding(docs):
    got = sharding.shard(docs, 3).collect()
    assert len(got) == docs.count()
    texts, load, slots, shard_of = Counter(table(docs)), Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shard_of[r.text_crc32, r.size].add(r.shard)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter({(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): 0 for d, t in texts} | Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in table(docs)))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for k, s in shard_of.items() if k[1] > 1)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "http://www.Example.com:8080/a?b=1#c", "<p>é</p>"), (2, "http://other.org", "<p>é</p>"), (3, None, None), (4, "bad url\nx", ""), (5, "http://a.b/x", "\r\n\r\nWARC/1.1\r\n"), (None, "http://a.b/y", "<p>é</p>"), (6, "http://a.b/x", "z" * 100_000), (6, "http://a.b/x", "z" * 100_000)]
    pages = spark.createDataFrame([(i, u, h, "f", 0) for i, u, h in rows], "page_id long, url string, html string, file string, at int")
    archive = warc.Archive.write(pages)
    found = archive.look_up(warc.keys_of(pages))
    got = Counter(tuple(r) for r in archive.fetch(found).collect())
    first: dict[bytes, int] = {}
    for i, _, h in rows:
        if i is not None:
            first[(h or "").encode()] = min(first.get((h or "").encode(), i), i)
    want: Counter = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        refers = first[b] if i is not None and first[b] != i else None
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if refers else "response", refers] += 1
    assert got == want
    one = spark.createDataFrame([(warc.url_key("http://a.b/x"), None)], "url_key string, page_id long")
    assert sorted(r.page_id for r in archive.look_up(one).collect()) == [5, 6, 6]
    assert warc.url_key(rows[0][1]) == "com,example,www:8080)/a?b=1"
    empty = warc.Archive.write(pages.limit(0))
    assert empty.fetch(empty.look_up(warc.keys_of(pages))).count() == 0


def test_kernel_by_enumeration():
    """The kernel with landmarks against all subsequences of three letters, counted one by one."""
    from itertools import combinations
    from math import exp, sqrt

    def vector(word):
        out = Counter()
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                out[word[i], word[j], word[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def kernel(x, y):
        a, b = vector(x), vector(y)
        norm = sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return exp(2 * toxicity.SHARP * ((sum(v * b[s] for s, v in a.items()) / norm if norm else 0) - 1))

    rng = random.Random(4)
    words = ["nitwit", "nitxwit", "nnitwit", "abab", "aaa", "aaaa", "ab", "", "blockhead", *("".join(rng.choice("abcdi") for _ in range(rng.randint(3, 14))) for _ in range(40))]
    marks = toxicity.Landmarks(words[:9] + words[20:30])
    got = marks.features(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks.words):
            assert abs(got[i, j] - kernel(w, m)) < 1e-5, (w, m)
    found = list(toxicity.subsequences(["abcabcab"]))
    assert abs(toxicity._norms(found[0][1], found[0][2])[0] - sqrt(sum(v * v for v in vector("abcabcab").values()))) < 1e-6


def test_what_is_pulled_apart_is_joined():
    for text in ("n i t w i t", "n  i\tt w i t!", "n . i . t . w . i . t", "N-I-T-W-I-T", "x nit wit y", "nit\n wit"):
        assert "nitwit" in {toxicity.letters(w) for w in toxicity.tokens(text)}, text
    assert "thecat" in toxicity.tokens("the cat sat") and "catsat" in toxicity.tokens("the cat sat") and "catchair" not in toxicity.tokens("cat chair")


def test_toxicity(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if bad := i % 4 == 0:
            text.insert(rng.randrange(20), rng.choice(["blockhead", "nitwit", "scumbag"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "then he said nitwwit again"), (1003, "n i t w i t and more"), (None, "a scumbag"), (1003, "clean words")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(got) == len(rows)
    held = {r.doc_id: r.predicted for r in got if r.held_out}
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    right = [held[i] == y for i, y in labels if i in held]
    assert sum(right) / len(right) > 0.97
    assert {r.predicted for r in got if r.doc_id in (1000, 1001)} == {0}
    assert {r.predicted for r in got if r.doc_id == 1002} == {1} and sorted(r.predicted for r in got if r.doc_id == 1003) == [0, 1]
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    none = toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).collect()
    assert {r.score for r in none} == {0.0}
    odd = docs.selectExpr("doc_id", "text", "1 AS toxic", "'x' AS words", "0.5D AS score", "doc_id AS held_out")
    model = toxicity.fit(odd, marks)
    assert toxicity.score(odd, model).columns == ["doc_id", "held_out", "score", "predicted"]
    assert toxicity.score(odd.limit(0), model).count() == 0 and toxicity.fit(odd.limit(0), marks) is None
    long = [f"{w}{i}" for i, w in enumerate(words * 13)] + ["scumbag"]  # the telling word of a text of 5000 stays
    assert "scumbag" in toxicity.tokens(" ".join(long))
    some = docs.where("doc_id < 400 AND doc_id % 4 = 0 AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0").limit(1).first().doc_id
    more = docs.where(f"doc_id <> {some}").unionByName(spark.createDataFrame([(some, " ".join(long))], "doc_id long, text string"))
    again = toxicity.score(more, toxicity.fit(more, marks)).where(f"doc_id = {some}").collect()
    assert [r.predicted for r in again] == [1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    text = lambda: "\n".join(" ".join(rng.choice(["the", "of", *map(str, range(500))]) for _ in range(12)) for _ in range(10))
    good = [text() for _ in range(60)]
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(i, t) for i, t in enumerate(good)] + [(100, good[0]), (101, good[1] + " extra words here"), (102, good[2] + "\n" + leak), (103, "short"), (104, "$$$ ### " * 60), (105, None), (106, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    work, now, seen = common.Work(spark, "t"), docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = work.save(stage(spark, now, str(tmp_path)), name)
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    assert {103, 104, 105, 106} & seen[0] == set() and set(range(60)) <= seen[0]
    assert 100 not in seen[1] and set(range(60)) <= seen[1] and 102 in seen[2]
    assert 102 not in seen[3] and set(range(60)) <= seen[3] and seen[4] == seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_verdicts_of_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    a, b, c, d, e = (" ".join(rng.choice([f"w{i}" for i in range(300)]) for _ in range(100)) for _ in range(5))
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        return Counter((r.doc_id, r.text) for r in out.collect())

    rows = [(None, a), (None, b + " " + leak), (7, c), (7, d + " " + leak), (8, e)]
    assert left(corpus_pipeline.decontamination, rows) == Counter([(None, a), (7, c), (8, e)])
    rows = [(3, a), (6, b), (6, a + " more"), (None, a), (None, c), (None, c + " more"), (9, d), (9, d)]
    got = left(corpus_pipeline.near_dedup, rows)
    assert sum(n for (_, t), n in got.items() if t.startswith(c)) == 1
    assert Counter({k: n for k, n in got.items() if not k[1].startswith(c)}) == Counter([(3, a), (6, b), (9, d)])


def test_sketches_of_partitions_sum_to_the_whole(spark):
    rng = np.random.default_rng(2)
    keys = common.mix(np.arange(5000, dtype=np.uint64))
    one, two = keys[:3000], keys[2000:]
    of = lambda k: substring.sketch(substring.counters(k, 1), np.zeros(len(k), np.int64))[2]
    whole, merged = substring.merge(of(np.concatenate([one, two]))), substring.merge(of(one) + of(two))
    assert (whole == merged).all()
    estimate = merged[substring.counters(keys, 1).astype(np.int64)].min(axis=0)
    assert (estimate[2000:3000] == 2).all() and (estimate >= 1).all() and (estimate[:2000] == 2).mean() < 0.05
    texts = spark.createDataFrame([(i // 10, " ".join(f"w{rng.integers(0, 40)}" for _ in range(60))) for i in range(50)], "block long, text string")
    sums = []
    for n in (1, 7):
        rows = substring.sketches(texts.repartition(n), 4).collect()
        assert {r.stripe for r in rows} == {0, 1, 2, 3} and {r.block for r in rows} == set(range(5))
        sums.append([substring.merge([r.counters for r in rows if r.stripe == s]) for s in range(4)])
    assert all((a == b).all() for a, b in zip(*sums, strict=True))


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, rows that repeat, columns with clashing names, and empty tables, at every stage."""
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda n: "\n".join(" ".join(rng.choice(["the", "of", *map(str, range(500))]) for _ in range(12)) for _ in range(n))
    good, long = [text(10) for _ in range(6)], text(2000)
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(i, t) for i, t in enumerate(good)] + [(None, text(10)), (None, None), (7, None), (8, ""), (9, long), (0, good[0]), (3, text(10)), (None, good[5] + "\n" + leak)]
    schema = "doc_id long, text string, lang string, n_chars int, _kept int, _bad int, _number int, number int, row string, node int, unnamed int, kept boolean, runs int, id int"
    docs = spark.createDataFrame([(i, t, None if j % 2 else "en", None, 1, 2, 3, 4, "r", 5, 6, False, 7, 8) for j, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(1, leak), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns
        left = Counter((r.doc_id, r.text) for r in out.collect()) if name != "best_fit_packing" else None
        if left is not None:
            assert out.columns == docs.columns
            assert out.schema.fieldNames() == docs.schema.fieldNames() and {(r._kept, r._bad, r.row, r.id) for r in out.collect()} <= {(1, 2, "r", 8)}
        if name == "quality_rules":
            assert left == Counter(rows) - Counter([(None, None), (7, None), (8, "")])
        if name == "line_dedup":
            assert left[0, good[0]] == 2 and left[9, long] == 1 and left[None, None] == 1 and left[8, ""] == 1
        if name == "near_dedup":
            assert left == Counter(rows) - Counter([(0, good[0])]) - Counter([(None, good[5] + "\n" + leak)])
        if name == "decontamination":
            assert left == Counter(rows) - Counter([(None, good[5] + "\n" + leak)])
        if name == "best_fit_packing":
            assert len({(r.doc_id, r.ids_crc32) for r in out.where("piece = 0").collect()}) == len(set((i, t or "") for i, t in rows))


def test_lists_and_postings_go_when_they_are_read(spark, docs, tmp_path, monkeypatch):
    """Of a search only what was found and the documents' lengths stay on disk."""
    monkeypatch.setattr("souk.llm.common.shared_folder", lambda spark: tmp_path.as_uri())
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    assert decontam.contamination(docs, items).count() == docs.count()
    assert {p.name for p in tmp_path.glob("*/*")} == {"phrases", "found", "lengths"}
