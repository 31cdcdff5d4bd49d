"""Ingestion as Structured Streaming: event-time chunks, exactly-once by sample key, resume guard, attempt log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def chunked(rows: DataFrame, at: str = "timestamp_s", seconds: float = 600.0) -> DataFrame:
    """Adds the number and start of the half-open event-time chunk."""
    return rows.withColumn("chunk_no", F.floor(F.col(at) / seconds).cast("long")).withColumn("chunk_start_s", F.floor(F.col(at) / seconds) * seconds)


def chunk_counts(stream: DataFrame, at: str, seconds: int, late: str, *keys: str) -> DataFrame:
    """Rows per key and tumbling window of a timestamp column; rows later than ``late`` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, f"{seconds} seconds"), *keys).agg(F.count(F.lit(1)).alias("n"))


def session_counts(stream: DataFrame, at: str, gap_s: int, late: str, *keys: str) -> DataFrame:
    """Sessions per key that end when over ``gap_s`` pass without a row."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, f"{gap_s} seconds"), *keys).agg(F.count(F.lit(1)).alias("n"))


def once(stream: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once: replays of an overlap are dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def check_resume(kept: dict | None, given: dict) -> None:
    """A scan resumes with the settings and the duration that it began with, or not at all."""
    if kept is not None:
        for k in ("config_hash", "config_json", "duration_s"):
            if kept.get(k) != given.get(k):
                raise ValueError(f"{k} differs from the scan that is resumed")


def run_available(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Commits all that is there in micro-batches; offsets are committed after ``commit``, which must be idempotent by batch id."""
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_attempts(work: Callable[[int], None], attempts: int = 3, first: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Runs ``work`` until it succeeds; the log of attempts. The last error is raised with its log."""
    log: list[dict] = []
    for no in range(1, attempts + 1):
        began = time.monotonic()
        try:
            work(no)
            log.append({"attempt_no": no, "error": None, "elapsed_s": time.monotonic() - began})
            return log
        except Exception as e:
            log.append({"attempt_no": no, "error": str(e), "elapsed_s": time.monotonic() - began})
            if no == attempts:
                e.attempts = log
                raise
            sleep(min(most, first * 2 ** (no - 1)))
    return log
