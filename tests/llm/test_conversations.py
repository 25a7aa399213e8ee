"""Repairs of conversations against a search over all edits, and damage and faults against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from souk.llm import conversations
from souk.llm.conversations import BLANK, CUT, DUPLICATE, NONE, Repair

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """(cost, audit, repaired) by uniform-cost search over whole audits: the first legal end found is the least (cost, audit)."""
    start = (0, "", 0, ())
    queue, seen = [start], set()
    while queue:
        cost, audit, at, out = heapq.heappop(queue)
        initials = "".join(r[:1] or "?" for r, _ in out)
        if at == len(turns) and LEGAL.fullmatch(initials):
            return cost, audit, out
        state = (at, initials[-1:], len(out) > 0)
        if (state, cost, audit) in seen:
            continue
        seen.add((state, cost, audit))

        def go(more, letter, step, row, cost=cost, audit=audit, at=at, out=out):
            longer = "".join(r[:1] or "?" for r, _ in [*out, *row])
            if re.fullmatch(r"s?(ua)*u?", longer):
                heapq.heappush(queue, (cost + more, audit + letter, at + step, (*out, *row)))

        for role in ("user", "assistant"):
            go(5, "I", 0, [(role, "")])
        if at < len(turns):
            role, text, fault = turns[at]
            go(2, "D", 1, [])
            if fault not in (BLANK, DUPLICATE):
                cut = 5 if fault == CUT else 0
                go(cut, "K", 1, [(role, text)])
                for other in ("user", "assistant"):
                    go(cut + 1, "R", 1, [(other, text)])
    raise AssertionError


def repaired(turns):
    own = Repair()
    for turn in turns:
        own.add(*turn)
    return own.result()


def expected(turns):
    cost, audit, out = cheapest(turns)
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_all_short_conversations():
    kinds = [(r, "x", f) for r in ("system", "user", "assistant") for f in (NONE, CUT)] + [("user", "", BLANK), ("bot", "y", NONE), ("", "z", NONE)]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert repaired(turns) == expected(turns), turns


def test_longer_conversations():
    rng = random.Random(11)
    for _ in range(250):
        turns = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice("abc"), rng.choice([NONE, NONE, NONE, CUT, BLANK, DUPLICATE])) for _ in range(rng.randint(4, 7))]
        assert repaired(turns) == expected(turns), turns


def brute(rows):
    by: dict = {}
    for conv_id, turn, role, text in rows:
        own = by.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv_id, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, *(y.encode() for y in x[1:])))
        turns, seen = [], set()
        for _, role, text in own:
            inked = re.findall(r"[^\x20\x09-\x0D]", text)
            turns.append((role, text, BLANK if not inked else DUPLICATE if (role, text) in seen else CUT if inked[-1] not in ".!?" else NONE))
            seen.add((role, text))
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, digest = repaired(turns)  # held against the search above
        out.append((conv_id, gaps, *(sum(f == k for *_, f in turns) for k in (BLANK, DUPLICATE, CUT)), illegal, cost, audit, digest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = ["Hello.", "What is it?", "It is so", "no end", "", " \t\n", None, "Yes!  ", "ünï.\x1c", "Hello.", " ", "a\nb.\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "User", None, "", "tool"]), rng.choice(texts)) for c in range(150) for t in range(rng.randint(1, 9)) if rng.random() > 0.1]
    rows += [(None, t, "user", "A question.") for t in range(5)] + [(900, None, "user", f"q{i}?") for i in range(4)] + [(901, 3, "assistant", "a."), (901, 3, "user", "b."), (901, 3, "user", "b.")]
    rows += [(902, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(3000)] + [(903, 1, "user", "long " * 100_000 + "end."), (904, -5, "user", "x."), (904, 9_000_000_000, "assistant", "y.")]
    dropped = next(i for i in range(10_000, 20_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone."), (dropped, 0, "assistant", "gone too.")]


def test_damage_and_repair(spark, rows):
    table = spark.createDataFrame([(*r, 7, "f", "c") for r in rows], "conv_id long, turn long, role string, text string, copies int, fault string, kind string")
    got = conversations.repair(conversations.damage(table))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert conversations.repair(conversations.damage(table.limit(0))).collect() == []
