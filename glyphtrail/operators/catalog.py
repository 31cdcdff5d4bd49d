"""Sources: admission, nested expansion, identities, safe metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_id

SAFE_FIELDS = ("id", "title", "channel_id", "upload_date", "duration_s", "width", "height", "resolution")


@dataclass(frozen=True)
class Admission:
    date_from: str | None = None
    date_to: str | None = None
    min_duration: float | None = None
    max_duration: float | None = None
    include: str | None = None
    exclude: str | None = None


def rejection(rules: Admission, title: Column, date: Column, duration: Column, live: Column | None = None) -> Column:
    """The first reason against a source, or null. Dates compare as digits without dashes."""
    day = F.regexp_replace(date, "-", "")
    checks: list[tuple[Column, str]] = []
    if rules.date_from or rules.date_to:
        checks.append((F.coalesce(day, F.lit("")) == "", "upload date unavailable"))
    if rules.date_from:
        checks.append((day < rules.date_from.replace("-", ""), "before date_from"))
    if rules.date_to:
        checks.append((day > rules.date_to.replace("-", ""), "after date_to"))
    if rules.min_duration is not None or rules.max_duration is not None:
        checks.append((duration.isNull(), "duration unavailable"))
    if rules.min_duration is not None:
        checks.append((duration < rules.min_duration, "shorter than min_duration"))
    if rules.max_duration is not None:
        checks.append((duration > rules.max_duration, "longer than max_duration"))
    if rules.include:
        checks.append((~F.coalesce(title, F.lit("")).rlike(f"(?i){rules.include}"), "title does not match include"))
    if rules.exclude:
        checks.append((F.coalesce(title, F.lit("")).rlike(f"(?i){rules.exclude}"), "title matches exclude"))
    if live is not None:
        checks.append((live, "live or upcoming"))
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in checks], F.lit(None).cast("string"))


def expand_entries(sources: DataFrame, entries: str, levels: int = 3) -> DataFrame:
    """Leaves of nested lists of entries (arrays of structs that may hold ``entries`` themselves), with their depth."""
    out, at = None, sources
    for depth in range(levels + 1):
        nested = entries in at.columns
        leaves = at.filter(F.col(entries).isNull() | (F.size(entries) == 0)).drop(entries) if nested else at
        leaves = leaves.withColumn("depth", F.lit(depth))
        out = leaves if out is None else out.unionByName(leaves, allowMissingColumns=True)
        if not nested:
            break
        at = at.filter(F.size(entries) > 0).select(F.explode(entries).alias("_e")).select("_e.*")
    return out


def local_id(path: Column) -> Column:
    return content_id(path, 20, "local-")


def safe_metadata(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in SAFE_FIELDS if c in rows.columns])


def usable_duration(duration: Column) -> Column:
    return F.when(~F.isnan(duration) & (F.abs(duration) < float("inf")) & (duration > 0), duration)
