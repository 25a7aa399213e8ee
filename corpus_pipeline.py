"""A training corpus from raw documents: five stages, each one of the operators of souk.llm.

Every stage is written as Parquet and read again as the next one's documents, so a lost executor costs a
part of one stage. All stages but the last return the columns of ``documents``, in their order.

Rows are documents, whatever their doc_id: a verdict on a row is carried by a number of its own, so rows that
share a doc_id, or have none, don't share it. Columns other than doc_id, text, lang and n_chars may have any
name and come out as they went in. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import bagminhash, decontam, lines, packing, quality
from souk.llm.common import Work, number_rows


def whole_row(docs: DataFrame):
    """All columns of a row in one, so that none can clash with those of a stage."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: too few words (null and empty texts too), too many repeats, a make-up unlike their language's.

    A null language is held against all; rows that repeat are each judged, alike; a very long text is read whole.
    """
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and with them documents of which no line is left.

    Earlier means a smaller doc_id, or a lesser hash of the text where two texts share one. Rows that repeat doc_id
    and text are one document and stay or go together; a row with a null doc_id or text stays as it is. n_chars is
    counted anew where a line went. A text may have any number of lines.
    """
    found = lines.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    columns = {"text": F.col("kept_text"), "n_chars": n_chars}
    left = found.where("n_removed = 0 OR n_removed < n_lines")
    return left.select(*(columns.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: that with the smallest doc_id (a null one is the largest), then the least hash of its text.

    Equal texts are one class, however often they repeat, empty ones too; a null text is a class of its own.
    """
    keyed = docs.select(whole_row(docs), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    work = Work(spark, "near")
    rows = number_rows(work, keyed, [], ["unnamed", "id", "key"], "number", "numbered")
    found = bagminhash.near_duplicates(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    # Those that go are mostly the fewer ones, and their stored table's size is known: whole rows needn't travel to a few numbers.
    gone = work.save(found.where("NOT kept").select(F.col("doc_id").alias("number")), "gone")
    return rows.join(gone, "number", "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a window of a benchmark item go, each by its own text, of any length. Null and empty texts have none and stay."""
    work = Work(spark, "decontaminated")
    rows = work.save(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("number")), "numbered")
    found = decontam.contamination(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = work.save(found.where("contaminated").select(F.col("doc_id").alias("number")), "contaminated")
    return rows.join(bad, "number", "left_anti").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut into pieces and packed.

    A null text is an empty one (its end id alone); rows that repeat are packed each; a very long text makes as many
    pieces as it takes; pieces of one length are told apart by (doc_id, piece, checksum), equal ones take any order.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Signatures, tokenizer and packing plan have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
