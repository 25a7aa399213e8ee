"""The log of runs: what every extract, stream and clean run read and wrote, and how it ended.

A run is known by its id and component. Its rows (one for each entity) are a folder of their own, so a run that is
recorded again, after a retry or a restart, replaces what it said before.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from souk.sources.lake import exists


@dataclass
class Run:
    """One entity's part of a run. Instants are UTC; ``metrics`` are whatever the component counts."""

    started_at: datetime
    finished_at: datetime
    entity: str = ""
    status: str = "ok"
    window_start: datetime | None = None
    window_end: datetime | None = None
    metrics: dict[str, float] = field(default_factory=dict)


class RunLog:
    FIELDS = "entity string, status string, started_at timestamp, finished_at timestamp, window_start timestamp, window_end timestamp, metrics map<string,double>"
    SCHEMA = f"{FIELDS}, component string, run_id string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, component: str, run_id: str, *runs: Run) -> None:
        rows = [(r.entity, r.status, r.started_at, r.finished_at, r.window_start, r.window_end, {k: float(v) for k, v in r.metrics.items()}) for r in runs]
        self.spark.createDataFrame(rows, self.FIELDS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/component={component}/run_id={run_id}")

    def all(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def of(self, component: str, *metrics: str) -> DataFrame:
        """A component's runs that ended well, with some of their metrics as columns (0 where a run has none)."""
        found = self.all().where((F.col("component") == component) & (F.col("status") == "ok"))
        counts = (F.coalesce(F.col("metrics")[m], F.lit(0.0)).cast("long").alias(m) for m in metrics)
        return found.select("run_id", F.col("entity"), "started_at", F.col("finished_at").alias("recorded_at"), "window_start", "window_end", *counts)

    def watermark(self, component: str, entity: str) -> datetime | None:
        """The end of the last window of an entity, fetched so that it bounds later reads as a literal; None before its first run."""
        return self.of(component).where(F.col("entity") == entity).agg(F.max("window_end")).collect()[0][0]


class RunLogs(RunLog):
    """Logs that components keep apart, read as one."""

    def __init__(self, parts: dict[str, RunLog]):
        self.parts = parts

    def record(self, component: str, run_id: str, *runs: Run) -> None:
        self.parts[component].record(component, run_id, *runs)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (log.all() for log in self.parts.values()))


class RunListener(StreamingQueryListener):
    """Records every streaming query of a session: batches, rows, and whether it failed. ``spark.streams.addListener(RunListener(log))``."""

    def __init__(self, log: RunLog, component: str = "query"):
        self.log, self.component = log, component
        self.running: dict[str, Run] = {}
        self.ended = threading.Condition()
        self.done: set[str] = set()

    def onQueryStarted(self, event) -> None:
        now = datetime.now(UTC)
        self.running[str(event.runId)] = Run(now, now, entity=event.name or "", metrics={"records": 0, "batches": 0, "milliseconds": 0})

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        own = self.running.get(str(progress.runId))
        if own and progress.numInputRows:
            for name, more in (("records", progress.numInputRows), ("batches", 1), ("milliseconds", progress.batchDuration)):
                own.metrics[name] += more

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        run_id = str(event.runId)
        own = self.running.pop(run_id, None)
        if own:
            own.finished_at, own.status = datetime.now(UTC), "failed" if event.exception else "ok"
            self.log.record(self.component, run_id, own)
        with self.ended:
            self.done.add(run_id)
            self.ended.notify_all()

    def wait_for(self, run_id: str, seconds: float = 30) -> bool:
        """Until a query's end is recorded (listeners hear of it some time after the query's own end)."""
        with self.ended:
            return self.ended.wait_for(lambda: run_id in self.done, seconds)
