"""Spark sessions with the settings that the engine relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC for every date function; AQE to coalesce and to split skewed joins; ANSI so that bad casts are loud.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session; ``more`` are settings with dots written as double underscores."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the one that all executors share (``spark.checkpoint.dir``).

    Where that is unset a single machine has one of its own, which goes when the process ends.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="souk-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        shared = Path(_own[0]).as_uri()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
