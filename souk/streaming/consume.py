"""Bounded consumption of a topic into the lake: how much a batch takes, when a run ends, and what it is logged with."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from souk.sources.messages import messages
from souk.sources.runlog import Run, RunLog
from souk.streaming.ingest import ingest


@dataclass
class Stats:
    """What a run consumed: all messages, those of them that were malformed, its batches, and the folders that it wrote."""

    records: int = 0
    malformed: int = 0
    batches: int = 0
    objects: int = 0


def consume(
    spark: SparkSession, where: str, topic: str, out: str, checkpoint: str, group: str = "lake", batch_size: int = 500, batch_seconds: float = 0.0,
    max_messages: int | None = None, max_seconds: float | None = None, from_beginning: bool = True, most_malformed: int | None = None,
    log: RunLog | None = None, run_id: str | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC),
) -> Stats:
    """Consume a topic until ``max_messages`` or ``max_seconds`` are reached (neither: until nothing is left) and log the run.

    A batch takes ``batch_size`` messages at most and begins every ``batch_seconds`` (0: at once). The source admits
    no message beyond the limits and what it has admitted is written before the run ends. The next run of the group goes on from
    the stored offsets: nothing is lost, nothing is read twice. A run that fails is logged as failed, with what it
    had written; its batch is written again by the next one, over the same folders.
    """
    stats, started, began = Stats(), now(), time.monotonic()

    def on_batch(number: int, good: int, bad: int) -> None:
        stats.records += good + bad
        stats.malformed += bad
        stats.batches += 1
        stats.objects += (good > 0) + (bad > 0)

    source = messages(
        spark, topic, where, stream=True, group=group, startingOffsets="earliest" if from_beginning else "latest",
        maxOffsetsPerTrigger=batch_size, maxMessages=max_messages, maxSeconds=max_seconds,
    )
    query = ingest(spark, source, out, checkpoint, {"processingTime": f"{batch_seconds} seconds"}, on_batch, most_malformed)
    status = "failed"
    try:
        while True:
            query.processAllAvailable()
            ended = max_messages is not None and stats.records >= max_messages
            if ended or max_seconds is None or time.monotonic() - began >= max_seconds:
                break
            time.sleep(min(0.5, max_seconds))
        status = "ok"
    finally:
        query.stop()
        if log:
            log.record("stream", run_id or str(query.runId), Run(started, now(), entity=topic, status=status, metrics=asdict(stats)))
    return stats
