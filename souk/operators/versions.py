"""Newest versions, slowly changing dimensions, incremental upserts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import surrogate_key


def latest_version(rows: DataFrame, keys: list[str], version: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, the one with the greatest version; of equal ones that with the greatest ``ties``, or any.

    Every partition keeps its newest row of a key before the shuffle, so a hot key costs a row a partition, and
    columns that nobody reads later are never read.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in (version, *ties)))
    return rows.withColumn("_nth", F.row_number().over(newest_first)).where("_nth = 1").drop("_nth")


def scd2_apply(history: DataFrame | None, source: DataFrame, key: str, updated: str, run_at: datetime) -> DataFrame:
    """Fold a source snapshot into a version history (columns of the source, valid_from, valid_to).

    A newer row closes its key's open version at the instant of its update and opens one from there; a key
    that is missing from the source has its open version closed at ``run_at``. One shuffle on the key.
    """
    columns = source.columns
    fresh = source.select(*columns, F.col(updated).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    if history is None:
        return fresh
    open_rows = history.where("valid_to IS NULL").select(F.col(key).alias("_key"), F.struct(*fresh.columns).alias("old"))
    new_rows = fresh.select(F.col(key).alias("_key"), F.struct(*fresh.columns).alias("new"))
    newer = F.col("old").isNull() | (F.col("new.valid_from") > F.col("old.valid_from"))
    closed_at = F.when(F.col("new").isNull(), F.lit(run_at)).when(newer, F.col("new.valid_from"))
    versions = F.array(
        F.when(F.col("old").isNotNull(), F.col("old").withField("valid_to", closed_at)),
        F.when(F.col("new").isNotNull() & newer, F.col("new")),
    )
    changed = open_rows.join(new_rows, "_key", "full").select(F.explode(F.filter(versions, lambda v: v.isNotNull())).alias("v")).select("v.*")
    return history.where("valid_to IS NOT NULL").unionByName(changed)


def scd2_from_changes(changes: DataFrame, key: str, at: str, columns: list[str], sequence: str, removed: str | None = None) -> DataFrame:
    """The history (key, columns, removed, sequence, valid_from, valid_to) that a full log of changes tells.

    Each change is valid until its key's next one; of changes at one instant the last by ``sequence`` counts. A change
    with ``removed`` is kept as one too, without values, so that changes that come later can be told into it
    (``scd2_merge_changes``); ``scd2_versions`` shows what a reader wants. Changes may come in any order; those
    without a key or an instant are left aside.

    Snapshots of the newest rows (``scd2_apply``) can't rebuild this: of several changes between two snapshots they
    see the last one only, of a change that comes late nothing if a later one was seen, and a removal is dated by the
    snapshot that missed the row. Their history goes forward from the first snapshot and is as fine as they are.
    """
    gone = F.coalesce(F.col(removed).cast("boolean"), F.lit(False)) if removed else F.lit(False)
    values = (F.when(~gone, F.col(c)).alias(c) for c in columns)
    told = changes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, *values, gone.alias("removed"), F.col(sequence).alias("sequence"), F.col(at).alias("valid_from"))
    last = latest_version(told, [key, "valid_from"], "sequence")
    return last.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from")))


def scd2_merge_changes(history: DataFrame, changes: DataFrame, key: str, at: str, columns: list[str], sequence: str, removed: str | None = None) -> DataFrame:
    """A history of ``scd2_from_changes`` with more changes: several of one key, and late ones, which split the interval that they fall in.

    The result is what the whole log would tell, in whatever parts it comes, and parts that come again change
    nothing. Only keys with changes are told anew.
    """
    more = scd2_from_changes(changes, key, at, columns, sequence, removed).drop("valid_to")
    touched = more.select(key).distinct()
    both = history.join(touched, key, "left_semi").select(*more.columns).unionByName(more)
    told = scd2_from_changes(both, key, "valid_from", columns, "sequence", "removed")
    return history.join(touched, key, "left_anti").select(*told.columns).unionByName(told)


def scd2_versions(history: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns, valid_from, valid_to) of a history of ``scd2_from_changes``: a version ends where a column changes or the key is removed, not at every change."""
    by_time = Window.partitionBy(key).orderBy("valid_from")
    state = F.struct("removed", *columns)
    starts = history.withColumns({"_state": state, "_before": F.lag(state).over(by_time)}).where("_before IS NULL OR NOT (_before <=> _state)")
    return starts.withColumn("valid_to", F.lead("valid_from").over(by_time)).where("NOT removed").select(key, *columns, "valid_from", "valid_to")


def with_version_key(history: DataFrame, key: str, name: str) -> DataFrame:
    """Add the surrogate key of each version, and whether it is the current one."""
    sk = surrogate_key(F.col(key), F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss"))
    return history.withColumns({name: sk, "is_current": F.col("valid_to").isNull()})


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, columns: dict[str, str]) -> DataFrame:
    """Left-join each fact with the version of its key at an instant, or with the current one where none was.

    ``columns`` maps a version's column to the name it gets. Both joins share the equi key, so they need one
    shuffle of the facts, and the range condition is evaluated inside the join.
    """
    then = versions.select(F.col(key), "valid_from", "valid_to", *(F.col(c).alias(f"_then_{c}") for c in columns))
    now = versions.where("is_current").select(F.col(key), *(F.col(c).alias(f"_now_{c}") for c in columns))
    f, v = facts.alias("f"), then.alias("v")
    inside = (F.col(f"f.{key}") == F.col(f"v.{key}")) & (F.col(f"f.{at}") >= F.col("v.valid_from")) & (F.col("v.valid_to").isNull() | (F.col(f"f.{at}") < F.col("v.valid_to")))
    joined = f.join(v, inside, "left").select("f.*", *(f"_then_{c}" for c in columns)).join(now, key, "left")
    return joined.select(*facts.columns, *(F.coalesce(f"_then_{c}", f"_now_{c}").alias(name) for c, name in columns.items()))


def since(rows: DataFrame, target: DataFrame | None, column: str, lookback: Column) -> DataFrame:
    """Rows newer than the target's newest, less a lookback; all rows where there is no target yet.

    The bound is fetched first, so that it reaches the scan as a literal.
    """
    newest = None if target is None else target.agg(F.max(column) - lookback).collect()[0][0]
    return rows if newest is None else rows.where(F.col(column) > F.lit(newest))


def upsert(target: DataFrame | None, delta: DataFrame, key: str) -> DataFrame:
    """Delete and insert by key: the delta's rows, and the target's rows of other keys."""
    if target is None:
        return delta
    return target.join(delta.select(key).distinct(), key, "left_anti").select(*target.columns).unionByName(delta)
