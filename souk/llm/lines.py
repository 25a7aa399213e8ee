"""Line dedup: later copies of repeated runs of lines, by a suffix array over line ids.

The corpus is one sequence of lines, document after document by doc_id (lines without a word are left out); a
suffix begins at a line and ends with its document. Suffixes whose first line occurs once have no part in any
repeat and stay out of the array. The others are sorted by prefix doubling: at level k each suffix has the rank
of its first 2**k lines (the place in the array where the suffixes that begin with these lines start), and the
pairs of ranks at i and i + 2**k, sorted and counted anew within each rank, are the ranks of level k + 1. A
suffix that is told apart from all others keeps its place, so the levels shrink; they end when only wholly
equal suffixes share a rank. Every level is a self-join and a sort by ranges, nothing is gathered.

The longest common prefix of neighbours in the array is found by descending the levels: as long as the ranks of
level k agree, both move on by 2**k lines. Suffixes between two that are followed by shorter common prefixes are
an interval of the array; what a suffix shares with an earlier place of the corpus is the longest prefix of an
interval that has an earlier suffix, and that is the one towards the nearest earlier suffix before it or behind
it in the array. One pass with a stack over each range finds these; the few that are open at a range's ends (no
earlier suffix inside) are settled by the same pass over them alone.

So every line knows the longest run from it on that occurs earlier: the maximal repeated runs and their ends. A
run of MIN_WORDS words goes, whole; the first copy of all stays, and so do shorter runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from souk.llm.common import Work, batches_of, lean, number_rows, running_totals, sliced

MIN_WORDS = 5


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))


def line_ids(texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, left, high, low): a 128-bit id of every line with a word (equal words, equal id), and how many are left from it on."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int64()), ("left", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, key, text in zip(*batch.columns, strict=True):
                doc_id, key = doc_id.as_py(), key.as_py()
                lines = [words for line in text.as_py().encode().split(b"\n") if (words := line.split())]
                for number, words in enumerate(lines):
                    high, low = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8").tolist()
                    yield doc_id, key, number, len(lines) - number, high, low

    return texts.select("doc_id", "text_key", "text").mapInArrow(lean(lambda b: batches_of(run(b), schema, 20_000)), "doc_id long, text_key long, line long, left long, high long, low long")


_LAST = (1 << 63) - 1


def _ranked(work: Work, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, n, first, before): the groups of equal keys, how many suffixes they have, the earliest one, and how many are in groups before."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    return running_totals(work, groups, keys, "n", "before", name)


def suffix_array(work: Work, lines: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Of ``lines`` (at, line, left, high, low) the suffixes whose first line repeats: by level and at last, (at, line, left, rank, n, first).

    ``n`` suffixes share the rank, ``first`` is the earliest of them; at last these are wholly equal. A level has
    the suffixes of the documents where some aren't told apart yet.
    """
    groups = lines.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1")
    groups = running_totals(work, groups, ["high", "low"], "n", "rank", "groups-0")
    now = work.save(lines.join(groups, ["high", "low"]).select("at", "line", "left", "rank", "n", "first"), "ranks-0")
    levels, last = [now], now.where("false")
    while True:
        level, step = len(levels) - 1, 1 << (len(levels) - 1)
        if now.where(f"n > 1 AND left > {step}").isEmpty():
            return levels, last.unionByName(now)
        # Suffixes that end before the step are equal to their end if they share a rank.
        after = now.select((F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        pairs = now.where(f"n > 1 AND left >= {step}").select("at", "left", "rank").join(after, "at", "left")
        ended = F.col("left") <= step
        alone = ~ended & F.col("next").isNull()  # the line there occurs once
        pairs = pairs.select("at", "rank", F.when(ended, -1).when(alone, _LAST).otherwise(F.col("next")).alias("next"), F.when(alone, F.col("at")).otherwise(-1).alias("alone"))
        pairs = work.save(pairs, f"pairs-{level}")
        keys = ["rank", "next", "alone"]
        groups = work.save(_ranked(work, pairs, keys, f"sorted-{level}"), f"groups-{level + 1}")
        starts = groups.groupBy("rank").agg(F.min("before").alias("start"))
        groups = groups.join(starts, "rank").withColumn("new", F.col("rank") + F.col("before") - F.col("start"))
        moved = pairs.join(groups, keys).select("at", "new", F.col("n").alias("new_n"), F.col("first").alias("new_first"))
        new = now.join(moved, "at", "left").select("at", "line", "left", F.coalesce("new", "rank").alias("rank"), F.coalesce("new_n", "n").alias("n"), F.coalesce("new_first", "first").alias("first"))
        whole = Window.partitionBy(F.col("at") - F.col("line"))  # a document
        table = work.save(new.withColumn("open", F.max(F.expr(f"n > 1 AND left >= {2 * step}")).over(whole)), f"ranks-{level + 1}")
        levels.append(table.drop("open"))
        now, last = table.where("open").drop("open"), last.unionByName(table.where("NOT open").drop("open"))
        work.drop(f"pairs-{level}", f"sorted-{level}", f"groups-{level}")


def common_prefixes(work: Work, levels: list[DataFrame], suffixes: DataFrame) -> DataFrame:
    """(rank, at, line, left, lcp): the different suffixes by rank, with the lines that each shares with the one before it."""
    last = suffixes.where("at = first").select("rank", "at", "line", "left")
    for level in range(min(2, len(levels))):
        last = last.join(levels[level].select("at", F.col("rank").alias(f"rank_{level}")), "at")
    if len(levels) < 2:
        last = last.withColumn("rank_1", F.lit(-1).cast("long"))
    array = work.save(number_rows(work, last, [], ["rank"], "place", "array-0"), "array")
    before = array.select((F.col("place") + 1).alias("place"), F.col("at").alias("p"), F.col("left").alias("left_p"), F.col("rank_0").alias("p_0"), F.col("rank_1").alias("p_1"))
    pairs = work.save(array.join(before, "place", "left"), "neighbours")
    # Most neighbours differ in their first or second line already.
    deep = pairs.where("rank_0 = p_0 AND rank_1 = p_1").select("rank", "at", "p", F.least("left", "left_p").alias("most"), F.lit(0).cast("long").alias("lcp"))
    for level in reversed(range(len(levels))):  # two places of one rank are in a rank that is shared
        own = lambda name: levels[level].where("n > 1").select(F.col("at").alias(f"{name}_at"), F.col("rank").alias(f"{name}_rank"))  # noqa: B023, E731
        deep = deep.withColumns({"x_at": F.col("at") + F.col("lcp"), "y_at": F.col("p") + F.col("lcp")}).join(own("x"), "x_at", "left").join(own("y"), "y_at", "left")
        agree = F.coalesce((F.col("lcp") < F.col("most")) & (F.col("x_rank") == F.col("y_rank")), F.lit(False))
        deep = deep.withColumn("lcp", F.col("lcp") + F.when(agree, 1 << level).otherwise(0)).drop("x_at", "y_at", "x_rank", "y_rank")
    deep = deep.select("rank", F.least("lcp", "most").alias("deep"))
    found = pairs.join(deep, "rank", "left")
    lcp = F.coalesce("deep", F.when(F.col("rank_0") == F.col("p_0"), 1).otherwise(0)).cast("long")
    return found.select("rank", "at", "line", "left", lcp.alias("lcp"))


def nearest_earlier(at: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """Of a range of the array, by place in the corpus and lines shared with the one before: the most lines that each
    shares with an earlier place among them; and the numbers of those that other ranges have to do with.

    Towards a range's end a place may gain what all between share, and no more; where it has that much already it is
    settled. For other ranges an earlier place that shares as much does instead of a later one. So of the places with
    no earlier one between them and an end two remain for each number of shared lines, which falls towards that end:
    a few of a range, whatever repeats in it.
    """
    longest, stack, n = [0] * len(at), [], len(at)
    for t in range(n):
        low = lcp[t]
        if low == 0 and t:
            stack.clear()
        while stack and at[stack[-1][0]] > at[t]:
            x, below = stack.pop()
            longest[x] = max(longest[x], low)
            low = min(low, below)
        if stack:
            longest[t] = max(longest[t], low)
        stack.append((t, low))
    kept = set()
    shared = np.minimum.accumulate(np.array(lcp, np.int64))  # with what stands before the range
    first = np.flatnonzero((np.minimum.accumulate(np.array(at, np.int64)) == at) & (shared > 0)).tolist()
    kept.update(t for t, later in zip(first, [*first[1:], -1], strict=False) if longest[t] < shared[t] or later < 0 or shared[later] < shared[t])
    shared = np.append(np.minimum.accumulate(np.array(lcp[:0:-1], np.int64))[::-1], _LAST)  # with what stands behind it
    last = [t for t, _ in stack]
    kept.update(t for earlier, t in zip([-1, *last], last, strict=False) if longest[t] < shared[t] or earlier < 0 or shared[earlier] < shared[t])
    return longest, sorted(kept)


def longest_earlier(work: Work, array: DataFrame) -> DataFrame:
    """(at, line, lines): the longest run from each different suffix's place on that occurs at an earlier place."""
    schema = pa.schema([("rank", pa.int64()), ("at", pa.int64()), ("line", pa.int64()), ("lines", pa.int64()), ("open", pa.bool_()), ("lcp", pa.int64())])
    ddl = "rank long, at long, line long, lines long, open boolean, lcp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if len(b)]) else None
        if table is None:
            return
        rank, at, line, lcp = (table.column(c).to_numpy() for c in ("rank", "at", "line", "lcp"))
        longest, unsettled = nearest_earlier(at.tolist(), lcp.tolist())
        is_open, least = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        if unsettled:  # they are as neighbours, so what they share is the least between them
            is_open[unsettled] = True
            starts = np.concatenate([[0], np.array(unsettled[:-1], np.int64) + 1])
            least[unsettled] = np.minimum.reduceat(lcp, starts)[: len(unsettled)]
            for i, (lo, hi) in enumerate(zip(starts.tolist(), unsettled, strict=True)):
                least[unsettled[i]] = lcp[lo : hi + 1].min()
        columns = [rank, at, line, np.array(longest, np.int64), is_open, least]
        yield from pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema).to_batches(20_000)

    columns = ("rank", "at", "line", "lcp")
    ordered = array.select(*columns).repartitionByRange("rank").sortWithinPartitions("rank")
    found = work.save(ordered.mapInArrow(lean(run), ddl), "ranges")
    # A few rows a range.
    ends = found.where("open").select(*columns).repartition(1).sortWithinPartitions("rank").mapInArrow(lean(run), ddl)
    both = found.select("at", "line", "lines").unionByName(ends.select("at", "line", "lines"))
    return both.groupBy("at", "line").agg(F.max("lines").alias("lines")).where("lines > 0")


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, runs): per text its (line, lines), the longest run from a line on that an earlier place has too."""
    work = Work(docs.sparkSession, "lines")
    texts = _texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = line_ids(texts).groupBy("doc_id", "text_key", "line").agg(*(F.first(c).alias(c) for c in ("left", "high", "low")))
    lines = number_rows(work, found, [], ["doc_id", "text_key", "line"], "at", "lines")
    levels, suffixes = suffix_array(work, lines.select("at", "line", "left", "high", "low"))
    array = work.save(common_prefixes(work, levels, suffixes), "prefixes")
    runs = longest_earlier(work, array).unionByName(suffixes.where("at > first").select("at", "line", F.col("left").alias("lines")))
    runs = runs.select((F.col("at") - F.col("line")).alias("start"), F.struct("line", "lines").alias("run"))
    begins = lines.where("line = 0").select(F.col("at").alias("start"), "doc_id", "text_key")
    out = work.save(runs.groupBy("start").agg(F.collect_list("run").alias("runs")).join(begins, "start").drop("start"), "out")
    work.drop("lines", "array-0", "array", "neighbours", "prefixes", "ranges", f"groups-{len(levels) - 1}", *(f"ranks-{i}" for i in range(len(levels))))
    return out


def _cut(text: str, runs: list[dict] | None, min_words: int) -> tuple[int, int, int, str]:
    """(lines with a word, lines that went, stretches of them, the text that is left)."""
    lines = text.encode().split(b"\n")
    numbered = [i for i, line in enumerate(lines) if line and not line.isspace()]
    if not runs:
        return len(numbered), 0, 0, text
    words = np.cumsum([0, *(len(lines[i].split()) for i in numbered)])
    line, n = np.array([[r["line"], r["lines"]] for r in runs]).T
    whole = words[line + n] - words[line] >= min_words
    change = np.zeros(len(numbered) + 1, np.int64)
    np.add.at(change, line[whole], 1)
    np.add.at(change, (line + n)[whole], -1)
    gone = np.cumsum(change[:-1]) > 0
    drop = {numbered[i] for i in np.flatnonzero(gone)}
    stretches = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
    return len(numbered), len(drop), stretches, b"\n".join(x for i, x in enumerate(lines) if i not in drop).decode() if drop else text


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, n_lines, n_removed, n_runs, kept_text): every text without its later copies of repeated runs.

    ``row`` is the whole row as it came. n_lines counts lines with a word, n_runs the stretches of lines that
    went. Lines are equal if their words are. A null text stays null and has no lines. A row with a null
    doc_id is compared with none. Of rows with one doc_id and different texts the one with the lesser hash of
    its text comes first; rows that repeat both are one document, and each returned. A text may have any number
    of lines, and columns any names. An empty table gives an empty result.
    """
    found = ["n_lines long", "n_removed long", "n_runs long", "kept_text string"]
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"))
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b)):
            texts = pc.struct_field(batch.column("row"), at).cast(pa.string())
            parts = [(0, 0, 0, None) if not text.is_valid else _cut(text.as_py(), runs.as_py(), min_words) for text, runs in zip(texts, batch.column("runs"), strict=True)]
            columns = list(zip(*parts, strict=True)) if parts else [()] * 4
            arrays = [batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *(f.split()[0] for f in found)])

    joined = rows.join(later_copies(docs), ["doc_id", "text_key"], "left").select("row", "runs")
    return joined.mapInArrow(lean(cut), StructType([rows.schema["row"], *(StructField(f.split()[0], LongType() if f.endswith("long") else StringType()) for f in found)]))


def op9_lines(spark, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
