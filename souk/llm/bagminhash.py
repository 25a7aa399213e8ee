"""Near-duplicate detection by BagMinHash signatures of word shingles.

A document is the multiset of its shingles of WORDS words. A signature has one component for each of M
hash functions; two documents agree in one with a probability equal to the weighted Jaccard similarity of
their multisets (sum of the lesser counts over sum of the greater). Each shingle runs Poisson processes of
points in time, each point in one component and at one weight; a component is the earliest of its points
whose weight the document's count reaches. Weights are discretised to whole counts and cut into dyadic
intervals (0,1], (1,2], (2,4], (4,8] ...: an interval that the count fills or cuts has one process of a rate
as large as its length, whose points are thinned by their weight, so a count of w costs log w processes,
not w. Points come in order of time and a process stops at the signature's greatest component, so that
nearly all shingles of a long document stop at their first points.

Signatures are cut into BANDS bands of ROWS components (a pair at similarity 0.8 is missed with a
probability of 3e-6). Documents that agree in a band are a bucket. No bucket is expanded into pairs: each
member is verified exactly against the bucket's leader, its member with the most company over all bands (the
original of a group of near copies has more than each copy), and verified links make components. Members that
aren't similar to their leader elect a leader among themselves, ELECTIONS times. What is left are members that
are in another component than others of the bucket; they meet these by what they differ in from the leader:

    Let Dx be the difference of x and its leader L (what one has and the other lacks). With the least
    similarity s and t = (1 - s) / (1 + s), x and y are similar if and only if |Dx ^ Dy| <= t (|x| + |y|),
    that is if Dx and Dy share (w(x) + w(y)) / 2 elements, w(x) = |Dx| - t |x|. For x not similar to L,
    w(x) > t |L|, and w(y) >= -t |L| for any y, so that every such pair shares some of its differences.

So no pair is lost if members meet by the rarest elements of their differences (as many as leave fewer than
they must share), and one whose position in both leaves too few isn't formed: changes that chance made in many
copies of a text don't meet, and a bucket of any size stays far from all pairs. What meets is verified
exactly. Copies of one text are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Chunk, Work, chunks, lean, mix, odd_constants, to_batch, window_hashes
from souk.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 42, 6
M = BANDS * ROWS
ELECTIONS = 2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(chunk: Chunk, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all shingles of a chunk; a text of fewer words is one shingle, one without words has none."""
    hashes, _, owner = chunk.windows(words)
    n = np.diff(chunk.first)
    short = np.flatnonzero((n > 0) & (n < words))
    whole = np.array([window_hashes(chunk.hashes[chunk.first[i] : chunk.first[i + 1]], int(n[i]), 7)[0] for i in short], np.uint64)
    return np.concatenate([hashes, whole]), np.concatenate([owner, short])


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) with their counts, sorted by text."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(hashes) else np.empty(0, np.int64)
    return hashes[first], owner[first], np.diff(np.append(first, len(hashes)))


def signatures(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """The n texts' signatures; a text without elements has only infinities."""
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    element = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    span = np.maximum(low, 1.0)
    with np.errstate(over="ignore"):
        seed = mix(hashes[element] + (level + 1).astype(np.uint64) * _GOLDEN)
    text, reach = owner[element], weight[element].astype(float)
    least = np.full(n * m, np.inf)
    bound = np.full(n, np.inf)
    time = np.zeros(len(seed))
    point = 0
    while len(seed):
        with np.errstate(over="ignore"):
            random = mix(seed + np.uint64(point) * _GOLDEN)
        time = time - np.log(((random >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / (m * span)
        alive = time < bound[text]
        seed, text, reach, low, span, time, random = (x[alive] for x in (seed, text, reach, low, span, time, random))
        other = mix(random ^ np.uint64(0xD1B54A32D192ED03))
        component = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        reached = low + span * ((other >> np.uint64(32)).astype(float) + 1) * 2.0**-32 <= reach
        np.minimum.at(least, (text * m + component)[reached], time[reached])
        if point < 16 or point % 8 == 0:
            bound = least.reshape(n, m).max(axis=1, initial=0)
        point += 1
    return least.reshape(n, m)


def bands(signature: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of every band of every signature."""
    parts = signature.view(np.uint64).reshape(len(signature), n_bands, rows)
    with np.errstate(over="ignore"):
        return mix((parts * odd_constants(rows, 31)).sum(axis=2, dtype=np.uint64) + np.arange(1, n_bands + 1, dtype=np.uint64) * _GOLDEN)


def _node(text):
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def sign(texts: DataFrame) -> DataFrame:
    """(node, keys): the text's node, and its bands' keys (none without words)."""
    schema = pa.schema([("node", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), size=3 << 20):
                n = len(chunk)
                keys = bands(signatures(*counted(*shingles(chunk)), n))
                some = np.diff(chunk.first) > 0
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.row, n), lists], schema=schema)

    return texts.select("node", "text").mapInArrow(lean(run), "node binary, keys array<long>")


def multisets(texts: DataFrame) -> DataFrame:
    """(node, elements): the sorted 64-bit hashes of (shingle, how manieth); shared ones count the lesser counts."""
    schema = pa.schema([("node", pa.binary()), ("elements", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                hashes, owner, weight = counted(*shingles(chunk))
                nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                with np.errstate(over="ignore"):
                    elements, owner = mix(np.repeat(hashes, weight) + nth.astype(np.uint64) * _GOLDEN), np.repeat(owner, weight)
                elements = elements[np.lexsort((elements, owner))]
                at = np.searchsorted(owner, np.arange(len(chunk) + 1))
                packed = [elements[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.row, len(chunk)), pa.array(packed, pa.binary())], schema=schema)

    return texts.select("node", "text").mapInArrow(lean(run), "node binary, elements binary")


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the multisets of both."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("elements").alias(f"of_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, distance) of pairs of nodes: one less their weighted Jaccard similarity, exactly."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                found.append(1 - shared / (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], schema=schema)

    return _both(pairs.select("a", "b"), sets).select("a", "b", "of_a", "of_b").mapInArrow(lean(run), "a binary, b binary, distance double")


def differences(stars: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, failed, size, weight, least, elements) of members b of leaders a that may be similar to another member of a.

    ``weight`` is w of the module's text, ``size`` how many ``elements`` differ; a pair shares ``least`` of them at least.
    """
    t = (1 - similarity) / (1 + similarity)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("failed", pa.bool_()), ("size", pa.int32()), ("weight", pa.float64()), ("least", pa.int32()), ("elements", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, failed, x, y in zip(*batch.columns, strict=True):
                leader, own = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                differ = np.setxor1d(leader, own, assume_unique=True)
                weight = len(differ) - t * len(own)
                least = max(1, int(np.ceil((weight + (-t if failed.as_py() else t) * len(leader)) / 2 - 1e-6)))
                if least <= len(differ):
                    rows.append((a.as_py(), b.as_py(), failed.as_py(), len(differ), weight, least, differ.view(np.int64)))
            if rows:
                yield to_batch(rows, schema)

    found = _both(stars, sets).select("a", "b", "failed", "of_a", "of_b")
    return found.mapInArrow(lean(run), "a binary, b binary, failed boolean, size int, weight double, least int, elements array<long>")


def possible_pairs(found: DataFrame, of: DataFrame, work: Work) -> DataFrame:
    """(a, b) of members of one leader, in different components, that share enough of their differences to be similar, as far as positions tell."""
    found = work.save(found.join(of.withColumnRenamed("node", "b"), "b", "left").withColumn("in", F.coalesce("component", "b")).drop("component"), "differences")
    each = found.select("a", "b", F.explode("elements").alias("element"))
    often = each.groupBy("a", "element").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # one that a member has alone meets nobody
    shared = each.join(often, ["a", "element"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("shared"))
    # Elements of one member alone come first in its order, so the shared ones start behind them.
    alone = F.col("size") - F.size("shared")
    prefix = F.greatest(F.lit(0), F.col("size") - F.col("least") + 1 - alone).cast("int")
    rows = found.drop("elements").join(shared, ["a", "b"]).withColumn("alone", alone)
    rows = rows.select("a", "b", "failed", "size", "weight", "in", "alone", F.posexplode(F.slice("shared", F.lit(1), prefix)).alias("at", "e"))
    rows = work.save(rows.select("a", "b", "failed", "weight", "in", F.col("e.element").alias("element"), (F.col("size") - F.col("alone") - F.col("at")).alias("left")), "prefixes")
    x = rows.where("failed").select("a", "element", F.col("b").alias("x"), F.col("weight").alias("of_x"), F.col("in").alias("in_x"), F.col("left").alias("left_x"))
    y = rows.select("a", "element", F.col("b").alias("y"), F.col("weight").alias("of_y"), F.col("in").alias("in_y"), F.col("left").alias("left_y"), F.col("failed").alias("failed_y"))
    enough = 2 * F.least("left_x", "left_y") >= F.col("of_x") + F.col("of_y") - 1e-6
    met = x.join(y, ["a", "element"]).where((F.col("in_x") != F.col("in_y")) & enough & (~F.col("failed_y") | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _led(members: DataFrame) -> DataFrame:
    """(key, leader, node): of the members (key, node, popularity) of every bucket the most popular one, and each other member."""
    leaders = members.groupBy("key").agg(F.max_by("node", F.struct("popularity", "node")).alias("leader"))
    return members.join(leaders, "key").where("node <> leader")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept): each row's class of near duplicates, named by its smallest doc_id.

    Two texts are linked if the multisets of their shingles are similar; classes are what links connect.
    Equal texts (and rows that repeat wholly) are in one class, those without words too; a null text is a class
    of its own. A text of fewer than WORDS words is one shingle; a very long one is taken whole. kept holds for
    the row that names its class (for each of them where rows repeat a doc_id). A null doc_id names a class
    only if all of the class are null. Other columns are left aside; an empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "bagminhash")
    most = 1 - similarity + 1e-9
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), _node(text).alias("node"))
    texts = rows.where("text IS NOT NULL")
    # Of each text one row, that with the smallest doc_id: the others are copies of a node.
    nodes = work.save(texts.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    one_each = texts.join(nodes.where("doc_id IS NOT NULL"), ["node", "doc_id"], "left_semi").groupBy("node", "doc_id").agg(F.first("text").alias("text"))
    unnamed = texts.where("doc_id IS NULL").join(nodes.where("doc_id IS NULL"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    one_each = work.save(one_each.select("node", "text").unionByName(unnamed), "texts")
    signed = work.save(sign(one_each).select("node", F.explode("keys").alias("key")), "keys")
    sizes = signed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = work.save(signed.join(sizes, "key"), "shared")
    popular = shared.groupBy("node").agg(F.sum("n").alias("popularity"))
    members = work.save(_led(shared.join(popular, "node").select("key", "node", "popularity")), "members-0")
    work.drop("keys", "shared")
    among = members.select(F.explode(F.array("leader", "node")).alias("node")).distinct()
    sets = work.save(multisets(one_each.join(among, "node", "left_semi")), "sets")
    work.drop("texts")
    known = None
    for turn in range(ELECTIONS + 1):
        stars = members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        if known is not None:
            stars = stars.join(known.select("a", "b"), ["a", "b"], "left_anti")
        new = work.save(distances(stars, sets), f"known-{turn}")
        known = new if known is None else known.unionByName(new)
        if turn == 0:
            first = members.select("key", "leader").distinct()
        failed = members.join(known.where(F.col("distance") > most).select(F.col("a").alias("leader"), F.col("b").alias("node")), ["leader", "node"], "left_semi")
        failed = failed.select("key", "node", "popularity")
        if turn == 0:
            left = work.save(failed.select("key", "node"), "failed")
        if turn == ELECTIONS or (members := work.save(_led(failed), f"members-{turn + 1}")).isEmpty():
            break
    links = known.where(F.col("distance") <= most).select("a", "b")
    found = components(links, work, "first")
    # Stars of leaders with a member that isn't similar: those that failed, and all others of the same leader.
    stars = known.join(left.join(first, "key").select(F.col("leader").alias("a")).distinct(), "a", "left_semi").withColumn("failed", F.col("distance") > most)
    pairs = possible_pairs(differences(stars.select("a", "b", "failed"), sets, similarity), found, work)
    more = work.save(distances(work.save(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), "possible"), sets), "more")
    links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more.where(F.col("distance") <= most).select("a", "b"))
    of_node = nodes.join(components(links, work), "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = of_node.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_node = work.save(of_node.join(classes, "component").select("node", "class_id"), "of_node")
    named = rows.where("text IS NOT NULL").select("doc_id", "node").join(of_node, "node").select("doc_id", "class_id")
    out = named.unionByName(docs.where("text IS NULL").select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("class_id")))
    out = work.save(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))), "classes")
    work.drop("nodes", "members-0", "sets", "failed", "possible", "more", "of_node", "differences", "prefixes", *(f"known-{i}" for i in range(turn + 1)), *(f"members-{i + 1}" for i in range(turn + 1)))
    return out


def op6_bagminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
