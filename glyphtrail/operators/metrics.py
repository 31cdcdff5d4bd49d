"""Accounting, digests, progress and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE, MEMORY, ADAPTATION_S, PRIOR_S = 0.6, 0.75, 120.0, 300.0


def stage_accounting(stages: DataFrame, run: str, wall: str, media: str) -> DataFrame:
    """Per run: rounded stage total, what is left, the largest stage, and the realtime factor. ``stages``: run, stage, seconds, wall, media."""
    sums = stages.groupBy(run, "stage").agg(F.sum("seconds").alias("s"), F.max(wall).alias("w"), F.max(media).alias("m"))
    out = sums.groupBy(run).agg(F.sum("s").alias("staged"), F.max("w").alias("wall"), F.max("m").alias("media"), F.min(F.struct((-F.col("s")).alias("x"), "stage")).alias("_l"))
    return out.select(run, F.round("staged", 6).alias("staged"), F.round(F.greatest(F.lit(0.0), F.col("wall") - F.col("staged")), 6).alias("other"), F.col("_l.stage").alias("largest"), F.try_divide("wall", "media").alias("realtime_factor"))


def grid_digest(samples: DataFrame, key: str, time: str, digits: int = 9) -> DataFrame:
    """Per key the count and the sha256 over the ordered times, each with a line end."""
    line = lambda t: F.format_string(f"%.{digits}f\n", t)
    ordered = F.array_sort(F.collect_list(F.col(time).cast("double")))
    return samples.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), F.sha2(F.array_join(F.transform(ordered, line), ""), 256).alias("digest"))


def grid_drift(samples: DataFrame, key: str, time: str, fps: float, start: Column | None = None) -> DataFrame:
    """Samples off the grid rank / fps by over 1e-8."""
    w = Window.partitionBy(key).orderBy(time)
    at = (start if start is not None else F.lit(0.0)) + (F.row_number().over(w) - 1) / fps
    return samples.withColumn("drift", F.abs(F.col(time) - at)).filter("drift > 1e-8")


def batch_deltas(counters: DataFrame, run: str, batch: str, counter: str) -> DataFrame:
    w = Window.partitionBy(run).orderBy(batch)
    return counters.withColumn("delta", F.col(counter) - F.coalesce(F.lag(counter).over(w), F.lit(0)))


def smoothed_rate(steps: DataFrame, key: str, order: str, distance: str, seconds: str, first: float = RATE, adaptation: float = ADAPTATION_S) -> DataFrame:
    """A distance-weighted moving average of seconds per unit of distance, folded over each key's ordered steps."""
    rows = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, distance, seconds))).alias("s"))

    def fold(rate: Column, x: Column) -> Column:
        share = 1 - F.exp(-x[distance] / adaptation)
        return F.when(x[distance] > 0, rate + share * (x[seconds] / x[distance] - rate)).otherwise(rate)

    return rows.select(key, F.aggregate("s", F.lit(first), fold).alias("rate"))


def cumulative_rate(steps: DataFrame, key: str, order: list[str], done: str, spent: str, prior: float = PRIOR_S, first: float = RATE) -> DataFrame:
    """The running ratio of time to work, smoothed by ``prior`` units at the rate ``first``."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("rate", (F.sum(spent).over(w) + prior * first) / (F.sum(done).over(w) + prior))


def compare_runs(runs: DataFrame, a: str, b: str, same: list[str], numbers: list[str]) -> DataFrame:
    """Field equality and differences of two labelled runs."""
    x, y = runs.filter(F.col("label") == a).alias("x"), runs.filter(F.col("label") == b).alias("y")
    return x.crossJoin(y).select(*[F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")).alias(f"same_{c}") for c in same], *[(F.col(f"y.{c}") - F.col(f"x.{c}")).alias(f"delta_{c}") for c in numbers])


def throughput(trials: DataFrame, group: str, items: str, seconds: str) -> DataFrame:
    return trials.groupBy(group).agg(F.try_divide(F.sum(items), F.sum(seconds)).alias("per_second"), F.avg(seconds).alias("mean_s"), F.median(seconds).alias("median_s"))
