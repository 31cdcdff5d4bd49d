"""Versions, queues and resume positions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_completed(scans: DataFrame, key: str, version: str, completed: Column) -> DataFrame:
    """The newest completed version of each key: one shuffle, no self join."""
    newest = Window.partitionBy(key).orderBy(F.col(version).desc())
    return scans.filter(completed).withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def select_scans(scans: DataFrame, scan_id: int | None = None, run_id: int | None = None) -> DataFrame:
    """One scan, a run's scans, or each source's latest completed scan."""
    if scan_id is not None and run_id is not None:
        raise ValueError("give a scan or a run, not both")
    if scan_id is not None:
        return scans.filter(F.col("id") == scan_id)
    if run_id is not None:
        return scans.filter((F.col("scan_run_id") == run_id) & (F.col("status") == "completed"))
    return latest_completed(scans, "video_id", "id", F.col("status") == "completed")


def work_queue(sources: DataFrame, key: str, wanted: Column, unfinished: DataFrame) -> DataFrame:
    """Sources in a wanted state or with an unfinished scan."""
    marked = sources.join(unfinished.select(key).distinct().withColumn("_open", F.lit(True)), key, "left")
    return marked.filter(wanted | F.col("_open")).drop("_open")


def resume_positions(chunks: DataFrame, key: str, completed: Column, end: str, reached: str) -> DataFrame:
    """How far each key got: the end of its completed chunks or the watermark of an open one."""
    return chunks.groupBy(key).agg(F.max(F.when(completed, F.col(end)).otherwise(F.col(reached))).alias("position"))


def next_ordinal(rows: DataFrame, key: str, number: str) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_no"))


def chunk_grid(sources: DataFrame, duration: str, seconds: float) -> DataFrame:
    """Half-open ranges of ``seconds``, the last one clipped; none for an empty duration."""
    n = F.ceil(F.col(duration) / seconds).cast("int")
    rows = sources.filter(F.col(duration) > 0).withColumn("sequence_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("chunk_start_s", F.col("sequence_no") * seconds).withColumn("chunk_end_s", F.least(F.col(duration), (F.col("sequence_no") + 1) * seconds))


def sample_grid(sources: DataFrame, start: str, end: str, fps: float) -> DataFrame:
    """Ticks start + i / fps below the end, with nine-digit keys."""
    n = F.ceil((F.col(end) - F.col(start)) * fps - 1e-9).cast("int")
    rows = sources.withColumn("_n", n).filter("_n > 0").withColumn("tick", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return rows.withColumn("timestamp_s", F.col(start) + F.col("tick") / fps).withColumn("sample_key", F.format_string("%.9f", F.col("timestamp_s")))


def short_reads(chunks: DataFrame, decoded: str, start: str, end: str, fps: float) -> DataFrame:
    """Chunks with over one frame fewer than their grid has."""
    return chunks.filter(F.col(decoded) < F.ceil((F.col(end) - F.col(start)) * fps - 1e-9) - 1)


def restart_offset(start: Column, watermark: Column, overlap: float, fps: float) -> Column:
    resume = F.greatest(start, F.coalesce(watermark, start))
    return F.greatest(F.lit(0.0), F.floor((resume - overlap) * fps) / fps)


def owned(time: Column, start: Column, end: Column) -> Column:
    """Half-open chunk ownership with the grid's tolerance."""
    return (time >= start - 1e-8) & (time < end - 1e-8)


def backoff(retry: Column, first: float = 2.0, most: float = 30.0) -> Column:
    return F.least(F.lit(most), first * F.pow(F.lit(2.0), retry))


def latest_unfinished(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """Each source's newest scan that is not completed, with its run's columns: what a resumed scan continues."""
    newest = Window.partitionBy("video_id").orderBy(F.col("id").desc())
    rows = scans.filter("status <> 'completed'").withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
    return rows.join(runs.select(F.col("id").alias("scan_run_id"), *[F.col(c).alias(f"run_{c}") for c in runs.columns if c != "id"]), "scan_run_id")


def in_window(tick: Column, interval: Column, start: float, end: float) -> Column:
    """Whether a tick's time lies in a half-open window."""
    return (tick * interval >= start) & (tick * interval < end)


def zipped(first: Column, second: Column) -> Column:
    """Two arrays as one of pairs (first, second); unlike lengths are an error."""
    pairs = F.zip_with(first, second, lambda a, b: F.struct(a.alias("first"), b.alias("second")))
    return F.when(F.size(first) == F.size(second), pairs).otherwise(F.raise_error(F.concat(F.size(first).cast("string"), F.lit(" results expected, got "), F.size(second).cast("string"))))


def enough_contrast(gray: Column, least_deviation: float = 4.0, least_edges: float = 0.01, step: float = 12.0) -> Column:
    """Whether a crop, rows of gray values, varies and has edges: deviation of its values, and the share of steps along its rows above ``step``."""
    flat = F.flatten(F.transform(gray, lambda r: F.transform(r, lambda v: v.cast("double"))))
    mean = F.aggregate(flat, F.lit(0.0), lambda s, v: s + v) / F.size(flat)
    deviation = F.sqrt(F.aggregate(F.transform(flat, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / F.size(flat))
    steps = F.flatten(F.transform(gray, lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: (F.abs(b - a) > step).cast("int"))))
    edges = F.aggregate(steps, F.lit(0), lambda s, v: s + v) / F.size(steps)
    return F.when((F.size(gray) < 2) | (F.size(gray[0]) < 2), F.lit(False)).otherwise((deviation >= least_deviation) & (edges >= least_edges))


def commit_points(rows: DataFrame, key: str, time: str, size: str, span: float = 20.0, most_rows: int = 10_000, most_bytes: int = 16 << 20) -> DataFrame:
    """Adds batch_no from 0: a batch ends with the row whose time is ``span`` after the batch's first, or that fills its rows or bytes.

    A batch begins where the one before ended, so a key's times and sizes are walked in order; times are unique within a key.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, time)}

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(time)
        numbers, first, n, held, no = [], None, 0, 0, 0
        for t, b in zip(part[time], part[size]):
            first, n, held = (t if first is None else first), n + 1, held + b
            numbers.append(no)
            if t - first >= span or n >= most_rows or held >= most_bytes:
                first, n, held, no = None, 0, 0, no + 1
        return pd.DataFrame({key: part[key], time: part[time], "batch_no": numbers})

    placed = rows.select(key, time, size).groupBy(key).applyInPandas(walk, f"{key} {kinds[key]}, {time} {kinds[time]}, batch_no long")
    return rows.join(placed, [key, time])
