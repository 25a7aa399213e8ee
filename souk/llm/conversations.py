"""Repair of conversations: the cheapest edits that give a legal order of roles.

A legal conversation is empty, or alternates user and assistant, from a user to an assistant, after at most one system
turn. Turns are kept, given another role, or deleted; turns without text are inserted.

Dynamic programming over retained turns (kept or reroled ones). What is retained last, a system, user or assistant
turn or nothing yet, decides what may follow and how many turns must be inserted between: the pair of roles does. The
turns between two retained ones are deleted, at the difference of two prefix sums; so of all places where a state was
reached only the one counts whose cost less its prefix sum is least, a running minimum a state. Of equal costs the
least audit wins: after the same turns no audit begins with another one (each ends with a turn's letter), so their
order is known from their ranks and the letters that are added, and audits needn't be held. A conversation passes as
a stream; what is held of it is three bytes a turn, from which its audit is read at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import batches_of, lean, small_batches, sliced

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Faults of turns: those of the first two are deleted in any case.
NONE, BLANK, DUPLICATE, CUT = range(4)
#: States: what was retained last.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_NAMES = {_USER: b"user", _ASSISTANT: b"assistant"}
#: For the state before and the role that follows: the roles to insert. Other pairs don't occur.
_BETWEEN = {
    (_NOTHING, _SYSTEM): (), (_NOTHING, _USER): (), (_SYSTEM, _USER): (), (_ASSISTANT, _USER): (), (_USER, _ASSISTANT): (),
    (_USER, _USER): (_ASSISTANT,), (_ASSISTANT, _ASSISTANT): (_USER,), (_NOTHING, _ASSISTANT): (_USER,), (_SYSTEM, _ASSISTANT): (_USER,),
}
_AT_END = {_NOTHING: (), _ASSISTANT: (), _USER: (_ASSISTANT,), _SYSTEM: (_USER, _ASSISTANT)}
_BEFORE = {role: [p for p, r in _BETWEEN if r == role] for role in (_SYSTEM, _USER, _ASSISTANT)}


def _turns(roles: tuple[int, ...], started: bool) -> bytes:
    """Inserted turns as they stand in a repaired conversation, behind others or at its start."""
    return b"".join((b"\n" if started or i else b"") + _NAMES[r] + b":" for i, r in enumerate(roles))


class Repair:
    """The cheapest repair of one conversation, turn by turn."""

    def __init__(self):
        self.deleted = 0  # cost of deleting all turns so far
        self.least: list[int | None] = [0, None, None, None]  # cost of each state less ``deleted`` where it was reached
        self.rank = [0, 0, 0, 0]  # order of the states' audits
        self.hashes = [hashlib.sha256(), None, None, None]  # of what is retained
        self.back = bytearray()  # of each turn and state but the first: 0 for deleted, else 1 + 2 * state before + whether reroled

    def add(self, role: str, text: str, fault: int) -> None:
        best: list[tuple | None] = [(self.rank[s], "D", s) if self.least[s] is not None else None for s in range(4)]
        least, back = list(self.least), [0, 0, 0]
        if fault not in (BLANK, DUPLICATE):
            for state in (_SYSTEM, _USER, _ASSISTANT):
                kept = role[:1] == " sua"[state]
                if state == _SYSTEM and not kept:
                    continue
                own = (0 if kept else REROLE) + (TRUNCATED if fault == CUT else 0) - DELETE
                for before in _BEFORE[state]:
                    if self.least[before] is None:
                        continue
                    n = len(_BETWEEN[before, state])
                    cost, order = self.least[before] + own + INSERT * n, (self.rank[before], "I" * n + ("K" if kept else "R"), before)
                    if best[state] is None or (cost, order) < (least[state], best[state]):
                        least[state], best[state], back[state - 1] = cost, order, 1 + 2 * before + (not kept)
        hashes = list(self.hashes)
        for state in (_SYSTEM, _USER, _ASSISTANT):
            if back[state - 1]:
                before = (back[state - 1] - 1) >> 1
                hashes[state] = self.hashes[before].copy()
                name = _NAMES[state] if back[state - 1] % 2 == 0 else role.encode()
                between = _turns(_BETWEEN[before, state], before != _NOTHING)
                hashes[state].update(between + (b"\n" if between or before != _NOTHING else b"") + name + b":" + text.encode())
        orders = sorted({b[:2] for b in best if b})
        self.rank = [orders.index(b[:2]) if b else 0 for b in best]
        self.least, self.hashes, self.deleted = least, hashes, self.deleted + DELETE
        self.back += bytes(back)

    def result(self) -> tuple[int, str, str]:
        """Cost, audit, SHA-256 of the repaired conversation."""
        cost, _, tail, state = min((self.least[s] + self.deleted + INSERT * len(_AT_END[s]), self.rank[s], "I" * len(_AT_END[s]), s) for s in range(4) if self.least[s] is not None)
        digest = self.hashes[state].copy()
        digest.update(_turns(_AT_END[state], state != _NOTHING))
        audit = bytearray(tail.encode())
        for i in range(len(self.back) - 3, -1, -3):
            code = self.back[i + state - 1] if state else 0
            if not code:
                audit += b"D"
                continue
            before = (code - 1) >> 1
            audit += (b"K" if code % 2 else b"R") + b"I" * len(_BETWEEN[before, state])
            state = before
        audit.reverse()
        return cost, audit.decode(), digest.hexdigest()


class _Conversation:
    """What is reported of one conversation."""

    def __init__(self):
        self.first = self.last = None
        self.distinct = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.initial: str | None = None
        self.repair = Repair()

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.faults[fault] += 1
        self.repair.add(role, text, fault)

    def row(self, conv_id: int | None) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return conv_id, gaps, *self.faults[1:], self.illegal, *self.repair.result()


_names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in _names), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _repair_all(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of rows sorted by conversation and turn."""
    conv_id, own = None, None
    for batch in batches:
        for part in sliced(batch):
            for at, turn, role, text, fault, copies in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if own is None or at != conv_id:
                    if own is not None:
                        yield own.row(conv_id)
                    conv_id, own = at, _Conversation()
                for copy in range(copies):
                    own.add(turn, role, text, DUPLICATE if copy and fault != BLANK else fault)
    if own is not None:
        yield own.row(conv_id)


def faults(turns: DataFrame) -> DataFrame:
    """Add ``fault`` to (conv_id, turn, role, text, copies), dealt by conversation. Rows of no copies count for nothing."""
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    present = F.col("copies") > 0
    earlier = Window.partitionBy("conv_id", "role", "text", present).orderBy(F.asc_nulls_first("turn"))
    found = F.when(end == "", BLANK).when(F.row_number().over(earlier) > 1, DUPLICATE).when(~end.isin(*ENDS), CUT).otherwise(NONE)
    return turns.repartition("conv_id").withColumn("fault", found)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): of turns by crc32 of ``conv_id:turn``, one in twenty each is dropped (no copies), emptied, freed of its marks, doubled, or given to the user."""
    conv_id, turn, role, text = (F.col(c).cast(t) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")))

    def or_space(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_space(conv_id), F.lit(":"), or_space(turn)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(or_space(text), ENDS, "")).otherwise(or_space(text))
    role = F.when(kind == 4, "user").otherwise(or_space(role))
    return conversations.select(conv_id.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in
    ``turns`` (conv_id, turn, role, text, copies: how often the row stands there; 0 for a row that only names its conversation).

    Turns are taken in ascending order, null ones first, equal ones by role and text. A null conv_id is one
    conversation; null roles and texts are one space; a role without a letter can't be kept; repeated rows are
    duplicates; a text of any length is one row; other columns are left aside; an empty table gives an empty one. A conversation of
    any length passes one task as a sorted stream, since the digest of its repaired text is one SHA-256.
    """
    small_batches(turns.sparkSession)
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space["role"], space["text"], "copies")
    rows = faults(plain).sortWithinPartitions(F.col("conv_id"), F.asc_nulls_first("turn"), "role", "text").select("conv_id", "turn", "role", "text", "fault", "copies")
    kinds = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _schema)
    return rows.mapInArrow(lean(lambda batches: batches_of(_repair_all(batches), _schema)), kinds)


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; nulls are one space (those of the damage's key too); other odd rows as ``repair`` states them."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS j, lag(role[1]) OVER w AS before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1] AS last
  FROM damaged WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text)),
turns AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY j) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed),
steps(s, t, ins) AS (VALUES ('', 's', []::VARCHAR[]), ('', 'u', []), ('s', 'u', []), ('a', 'u', []), ('u', 'a', []),
  ('u', 'u', ['assistant:']), ('a', 'a', ['user:']), ('', 'a', ['user:']), ('s', 'a', ['user:'])),
moves AS (
  SELECT s, t, ins, 'K' AS letter FROM steps UNION ALL SELECT s, t, ins, 'R' FROM steps WHERE t <> 's'
  UNION ALL SELECT s, s, []::VARCHAR[], 'D' FROM (VALUES (''), ('s'), ('u'), ('a')) AS x(s)),
best(c, j, s, cost, audit, turned) AS (
  SELECT DISTINCT c, 0::BIGINT, '', 0::BIGINT, '', []::VARCHAR[] FROM keyed
  UNION ALL
  SELECT c, j, t, costs, edits, turned FROM (
    SELECT b.c, x.j, m.t, b.cost + CASE letter WHEN 'D' THEN 2 ELSE 5 * len(ins) + (letter = 'R')::INT + 5 * (fault = 'truncated')::INT END AS costs,
      b.audit || repeat('I', len(ins)) || letter AS edits,
      CASE letter WHEN 'D' THEN turned ELSE turned || ins || [CASE letter WHEN 'K' THEN role WHEN 'R' THEN CASE m.t WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':' || text] END AS turned
    FROM best b JOIN turns x ON x.c = b.c AND x.j = b.j + 1 JOIN moves m ON m.s = b.s
    WHERE letter = 'D' OR fault IN ('none', 'truncated') AND (letter = 'R' OR role[1] = m.t)
    QUALIFY row_number() OVER (PARTITION BY b.c, m.t ORDER BY costs, edits) = 1)),
ends(s, ins) AS (VALUES ('', []::VARCHAR[]), ('a', []), ('u', ['assistant:']), ('s', ['user:', 'assistant:'])),
sums AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY c),
done AS (
  SELECT b.c, cost + 5 * len(ins) AS costs, audit || repeat('I', len(ins)) AS edits, array_to_string(turned || ins, chr(10)) AS repaired
  FROM best b JOIN ends USING (s) LEFT JOIN sums t ON t.c = b.c WHERE b.j = coalesce(n, 0)
  QUALIFY row_number() OVER (PARTITION BY b.c ORDER BY costs, edits) = 1)
SELECT DISTINCT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, costs::BIGINT AS cost, edits AS audit, sha256(repaired) AS repaired_sha256
FROM keyed JOIN done USING (c) LEFT JOIN sums USING (c)
"""
