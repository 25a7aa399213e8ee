"""The pipeline's jobs by command line: ``python -m souk extract|load|consume|clean|check``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from souk.operators import clean
from souk.plans import operations
from souk.session import session
from souk.sources import contracts, database, lake
from souk.sources.runlog import RunLog
from souk.streaming.consume import consume


def instant(text: str) -> datetime:
    """ISO 8601, UTC where no zone is given; without a zone, as Spark's UTC session takes it."""
    found = datetime.fromisoformat(text)
    return found.astimezone(UTC).replace(tzinfo=None) if found.tzinfo else found


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def chosen(text: str | None) -> list[str]:
    """Tables by name; one that there is no contract for is an error."""
    tables = text.split(",") if text else list(contracts.CONTRACTS)
    if unknown := set(tables) - set(contracts.CONTRACTS):
        raise SystemExit(f"unknown tables: {', '.join(sorted(unknown))}")
    return tables


def extract(spark: SparkSession, args: argparse.Namespace) -> int:
    tables = chosen(args.tables)
    keys = database.key_registry(spark, args.url, tables)
    rows = {t: (database.read_by_key(spark, args.url, t, keys[t], args.connections), keys[t]) for t in tables}
    end = args.end or now()
    runs, log = lake.Runs(spark, f"{args.out}/_runs"), RunLog(spark, args.log) if args.log else None
    found = lake.run_extracts(rows, args.out, runs, end, now(), args.start, args.history_days, timedelta(minutes=args.lookback_minutes), args.dry_run, args.run_id, log)
    for r in found:
        print(f"{r.table}: {r.rows} rows from {r.start} to {r.end}{'' if r.path else ', nothing written'}")
    return 0


def load(spark: SparkSession, args: argparse.Namespace) -> int:
    for r in contracts.load_all(spark, args.lake, args.warehouse, args.quarantine, chosen(args.tables), args.truncate):
        print(f"{r.table}: {r.skipped}" if r.skipped else f"{r.table}: {r.rows} rows loaded, {r.quarantined} in quarantine")
    return 0


def run_consumer(spark: SparkSession, args: argparse.Namespace) -> int:
    log = RunLog(spark, args.log) if args.log else None
    found = consume(spark, args.where, args.topic, args.out, args.checkpoint, args.group_id, args.batch_size, args.batch_seconds, args.max_messages, args.max_seconds, args.from_beginning, args.most_malformed, log)
    print(f"{found.records} records, {found.malformed} malformed, {found.batches} batches, {found.objects} folders")
    return 0


def run_clean(spark: SparkSession, args: argparse.Namespace) -> int:
    r = clean.run(spark, args.raw, args.out, args.lookback_hours, args.full, args.now, RunLog(spark, args.log) if args.log else None)
    print(f"{r.input_rows} rows in, {r.output_rows} out, {r.duplicates_removed} duplicates, {r.partitions_written} partitions, {r.seconds:.1f} s")
    return 0


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    """The newest stored counts of a folder's tables; 1 if any disagree and ``--fail-on-mismatch`` is given."""
    rows = operations.stored(spark, args.folder, "counts")
    wrong = rows.where("difference <> 0").orderBy(F.asc_nulls_last("check_date"))
    n, bad = rows.count(), wrong.count()
    for r in wrong.limit(20).collect():
        print(f"{r.entity} {r.check_date or 'total'}: {r.source_count} at the source, {r.warehouse_count} in the warehouse")
    print(f"{n} checks, {bad} mismatches")
    return int(bool(bad) and args.fail_on_mismatch)


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="souk")
    found.add_argument("--master")
    found.add_argument("--driver-memory", default="4g")
    jobs = found.add_subparsers(required=True)

    def job(name: str, run: Callable, *needed: str, log: bool = True) -> argparse.ArgumentParser:
        own = jobs.add_parser(name)
        own.set_defaults(run=run)
        for option in needed:
            own.add_argument(f"--{option}", required=True)
        if log:
            own.add_argument("--log", help="folder of the run log; none: the run isn't logged")
        return own

    own = job("extract", extract, "url", "out")
    own.add_argument("--tables", help="names with commas between (default: all)")
    window = own.add_mutually_exclusive_group(required=True)
    window.add_argument("--incremental", action="store_true", help="from each table's watermark")
    window.add_argument("--start", type=instant)
    own.add_argument("--end", type=instant)
    own.add_argument("--run-id")
    own.add_argument("--lookback-minutes", type=float, default=0.0)
    own.add_argument("--history-days", type=int, default=30)
    own.add_argument("--connections", type=int, default=8)
    own.add_argument("--dry-run", action="store_true", help="count rows, write nothing")

    own = job("load", load, "lake", "warehouse", "quarantine", log=False)
    own.add_argument("--tables")
    own.add_argument("--truncate", action="store_true")

    own = job("consume", run_consumer, "where", "topic", "out", "checkpoint")
    own.add_argument("--group-id", default="lake")
    own.add_argument("--batch-size", type=int, default=500)
    own.add_argument("--batch-seconds", type=float, default=0.0)
    own.add_argument("--max-messages", type=int)
    own.add_argument("--max-seconds", type=float)
    own.add_argument("--most-malformed", type=int)
    own.add_argument("--from-beginning", action="store_true")

    own = job("clean", run_clean, "raw", "out")
    own.add_argument("--lookback-hours", type=float, default=3.0)
    own.add_argument("--full", action="store_true")
    own.add_argument("--now", type=instant)

    own = job("check", check, "folder", log=False)
    own.add_argument("--fail-on-mismatch", action="store_true")
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    own = spark or session(args.master, spark__driver__memory=args.driver_memory)
    try:
        return args.run(own, args)
    finally:
        if spark is None:
            own.stop()


if __name__ == "__main__":
    sys.exit(main())
