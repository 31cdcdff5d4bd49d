"""Window-style computations over ordered observations: sessions, running aggregates, motion, ordered texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize


def gap_sessions(rows: DataFrame, keys: list[str], time: str, gap: float, order: list[str] | None = None) -> DataFrame:
    """Adds session_no from 0: a new one where the time since the row before exceeds ``gap``; equality stays."""
    w = Window.partitionBy(*keys).orderBy(time, *(order or []))
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w).cast("long")).drop("_new")


def track_aggregate(rows: DataFrame, keys: list[str], time: str, text: str, confidence: str, arrival: str) -> DataFrame:
    """Start, end, support, and the text of the best confidence: null loses to any, the first of equal ones stays."""
    best = F.min(F.struct((-F.coalesce(F.col(confidence), F.lit(float("-inf")))).alias("c"), F.col(arrival).alias("a"), F.col(text).alias("t"), F.col(confidence).alias("v")))
    out = rows.groupBy(*keys).agg(F.min(time).alias("start_s"), F.max(time).alias("end_s"), F.count(F.lit(1)).alias("support_count"), F.count_distinct(time).alias("distinct_times"), best.alias("_b"))
    return out.select(*keys, "start_s", "end_s", "support_count", "distinct_times", F.col("_b.v").alias("best_confidence"), F.col("_b.t").alias("canonical_text"))


def velocity(rows: DataFrame, keys: list[str], time: str, value: str, order: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time, *(order or []))
    dt = F.col(time) - F.lag(time).over(w)
    return rows.withColumn("velocity", F.try_divide(F.col(value) - F.lag(value).over(w), dt)).withColumn("running_count", F.row_number().over(w).cast("long"))


def ordered_distinct(rows: DataFrame, keys: list[str], order: list[str], text: str, name: str) -> DataFrame:
    """The distinct texts of a group in order of first sight. Repeats are reduced before the group is gathered."""
    first = rows.groupBy(*keys, text).agg(F.min(F.struct(*order)).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", text))), lambda x: x[text]).alias(name))


def top_per_group(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` of each group, with the group's size and how many the cap dropped."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("of", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("place") <= k).withColumn("capped", F.greatest(F.lit(0), F.col("of") - k).cast("long"))


def scored_first(rows: DataFrame, keys: list[str], score: str, row_id: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), row_id)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def support(scored: DataFrame, keys: list[str], weak: float) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count_distinct(F.when(F.col("score") >= weak, F.col("timestamp_s"))).alias("support_count"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds each row's place from 1 in an order of all rows. The rows are ranged by Spark's sort and numbered by their ranges' counts, never in one task.

    The ranges are written once and read twice: Spark samples their bounds, so ranges that are computed again can be other ranges.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = materialize(ranged, "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
