"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (document, position, term) for every training token, whatever will be looked for,
and one of the end marker for each document, whose position is the document's length. It is stored by
document, so every shard has whole documents and building it moves nothing between machines; one index
serves any number of benchmarks. A search takes the lists of its own terms out of it.

A phrase is found from its rarest term: the term's postings, less its offset in the phrase, are the possible
starts; they are intersected with the offset-adjusted postings of the second and third rarest, and what is
left with those of all other terms. Only postings of documents that are still possible are looked at then.
Candidates and postings grow with the corpus, so they meet in merge joins, never by a broadcast; only the
numbers of the documents that are still possible are broadcast, as long as their table is below Spark's limit.
Proximity matches ask of each other term a posting within ``slop`` places of where the phrase has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import Work, number_rows

SIZE = 10
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same class by what is in it: a union of ranges that is not negated is matched twelve times as fast.
_WORDS = r"[0-9a-z\x80-\x{10FFFF}]+"
_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms are never empty, so this one is free to mark a document's end.
END = ""


def words(text: Column) -> Column:
    """Runs of letters and digits (all beyond ASCII counts as such), A-Z in lower case."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _upper, _lower))
    return F.regexp_extract_all(low, F.lit(_WORDS), F.lit(0))


def item_phrases(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, phrase, terms): every item's windows of ``size`` words; an item of fewer is one window."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - (size - 1), F.lit(1)))
    windows = split.select("item", F.explode(F.transform(starts, lambda s: F.slice("terms", s, size))).alias("terms"))
    return windows.select("item", F.concat_ws(" ", "terms").alias("phrase"), "terms").distinct()


class Index:
    """Postings of all tokens of ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
        tokens = numbered.select("row", "doc_id", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("at", "term"))
        self.work = Work(docs.sparkSession, "postings")
        self.postings = self.work.save(tokens, "index")

    def documents(self) -> DataFrame:
        """(row, doc_id, n_words)."""
        return self.postings.where(F.col("term") == END).select("row", "doc_id", F.col("at").cast("long").alias("n_words"))


class Search:
    """The lists of the terms of ``phrases`` (phrase, terms) in an index, and where they meet."""

    def __init__(self, index: Index, phrases: DataFrame):
        self.work = work = Work(phrases.sparkSession, "lists")
        terms = number_rows(work, phrases.select(F.explode("terms").alias("term")).distinct(), [], ["term"], "term_id", "terms").select("term", F.col("term_id").cast("int"))
        self.postings = work.save(index.postings.join(terms, "term").select("row", "at", "term_id"), "lists")
        counts = work.save(self.postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("n")), "counts")
        offsets = phrases.select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(terms, "term").join(counts, "term_id")
        whole = Window.partitionBy("phrase")  # of a phrase's words: SIZE rows at most
        offsets = offsets.withColumn("known", F.count(F.lit(1)).over(whole)).where("known = size")  # a term without postings rules a phrase out
        ranked = offsets.withColumn("rarity", F.row_number().over(whole.orderBy("n", "offset")) - 1)
        self.offsets = work.save(ranked.select("phrase", "size", "offset", "term_id", "rarity"), "offsets")

    def _of(self, rarity: int) -> DataFrame:
        return self.offsets.where(F.col("rarity") == rarity)

    def _rarest(self) -> DataFrame:
        """(phrase, size, row, start) by the rarest term; a start before the document's is negative."""
        first = self.postings.join(self._of(0), "term_id")
        return first.select("phrase", "size", "row", (F.col("at") - F.col("offset")).alias("start"))

    def exact(self) -> DataFrame:
        """(phrase, size, row, start) of every occurrence."""
        found = self._rarest().where("start >= 0")
        for rarity in (1, 2):
            own = self._of(rarity)
            there = self.postings.join(own.select("term_id").distinct(), "term_id", "left_semi").select("row", "at", "term_id")
            wanted = found.where(F.col("size") > rarity).join(own.select("phrase", "offset", "term_id"), "phrase").withColumn("at", F.col("start") + F.col("offset"))
            met = wanted.join(there.hint("merge"), ["row", "at", "term_id"], "left_semi").select("phrase", "size", "row", "start")
            found = self.work.save(met.unionByName(found.where(F.col("size") <= rarity)), f"met-{rarity}")
        rest = self.offsets.where("rarity > 2").select("phrase", "offset", "term_id")
        open_rows = self.work.save(found.where("size > 3").select("row").distinct(), "open")  # stored, so that its size is known
        there = self.postings.join(open_rows, "row", "left_semi").join(rest.select("term_id").distinct(), "term_id", "left_semi").select("row", "at", "term_id")
        wanted = found.where("size > 3").join(rest, "phrase").withColumn("at", F.col("start") + F.col("offset"))
        met = wanted.join(there.hint("merge"), ["row", "at", "term_id"], "left_semi").groupBy("phrase", "size", "row", "start").agg(F.count(F.lit(1)).alias("n"))
        return met.where("n = size - 3").drop("n").unionByName(found.where("size <= 3"))

    def proximity(self, slop: int) -> DataFrame:
        """(phrase, size, row, start) where every term is within ``slop`` places of where the phrase has it; start may be negative."""
        found = self._rarest().distinct()
        rest = self.offsets.where("rarity > 0").select("phrase", "offset", "term_id")
        near = found.join(rest, "phrase").join(self.postings.select("row", "at", "term_id"), ["row", "term_id"]).where(F.abs(F.col("at") - F.col("start") - F.col("offset")) <= slop)
        met = near.groupBy("phrase", "size", "row", "start").agg(F.countDistinct("offset").alias("n")).where("n = size - 1").drop("n")
        return met.unionByName(found.where("size = 1"))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): what each document has of the benchmark.

    A word inside any occurrence of an item's window is hit; items are those with occurring windows. A null
    text has no words, and items without words have no windows. Rows that repeat a doc_id are documents of
    their own, a null doc_id stays null; items that repeat an item_id are one, a null item_id is the empty
    one. A very long text is one row of postings a word, like any other; windows that begin at one place, or lie
    over each other, hit a word once. Other columns are left aside; an empty table of documents gives an empty
    result, one of items no hit.
    """
    work = Work(docs.sparkSession, "decontam")
    phrases = work.save(item_phrases(items, size), "phrases")
    index = Index(docs)
    search = Search(index, phrases.select("phrase", "terms").distinct())
    found = work.save(search.exact(), "found")
    lengths = work.save(index.documents(), "lengths")
    # Nothing looks into the lists and the postings any more, and these are larger than the texts.
    search.work.drop("terms", "lists", "counts", "offsets", "met-1", "met-2", "open")
    index.work.drop("index")
    end = F.col("start") + F.col("size")
    earlier = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "start", "size").distinct().withColumn("upto", F.max(end).over(earlier))
    hits = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("upto", "start")))).cast("long").alias("n_hit"))
    of_items = found.select("row", "phrase").distinct().join(phrases.select("phrase", "item"), "phrase").select("row", "item").distinct()
    lists = of_items.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
    out = lengths.join(hits, "row", "left").join(lists, "row", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.lit("")).cast("binary")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_decontam(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_upper}', '{_lower}'), '{WORDS}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_upper}', '{_lower}'), '{WORDS}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {SIZE}) AS n, array_to_string(w[s : s + least(len(w), {SIZE}) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM places p JOIN windows w ON p.phrase = w.phrase AND p.n = w.n),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM met) GROUP BY doc_id),
lists AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN lists USING (doc_id)
"""
