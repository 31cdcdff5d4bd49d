"""Retrieval and recognition quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import promote

THRESHOLDS = (0.65, 0.82, 0.95, 1.0)


def threshold_metrics(scored: DataFrame, groups: list[str], score: str, positive: Column, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """Per group and threshold: tp, fp, positives, precision, recall (null over nothing). One pass, one narrow shuffle."""
    aggs = [F.count_if(positive).alias("positives")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((F.col(score) >= t) & positive).alias(f"tp{i}"), F.count_if((F.col(score) >= t) & ~positive).alias(f"fp{i}")]
    sums = scored.groupBy(*groups).agg(*aggs)
    rows = sums.select(*groups, "positives", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)])).alias("m"))
    return rows.select(*groups, "m.threshold", "m.tp", "m.fp", "positives", F.try_divide("m.tp", F.col("m.tp") + F.col("m.fp")).alias("precision"), F.try_divide("m.tp", "positives").alias("recall"))


def by_dimension(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Rows once for each ``name=value`` group they belong to."""
    tags = F.array(*[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in dimensions.items()])
    return rows.withColumn("group_name", F.explode(tags))


def error_rate(rows: DataFrame, truth: Column, text: Column, groups: list[str]) -> DataFrame:
    """Exact-match share and edits per true character."""
    sums = rows.groupBy(*groups).agg(F.avg((truth == text).cast("double")).alias("exact"), F.sum(F.levenshtein(truth, text)).cast("long").alias("edits"), F.sum(F.char_length(truth)).cast("long").alias("chars"))
    return sums.withColumn("cer", F.col("edits") / F.greatest(F.lit(1), F.col("chars")))


def occurrence_recall(scored: DataFrame, source: str, positive: str, strong: float, weak: float, gap: float) -> DataFrame:
    """Occurrences that are positive, and found by promotion; the same per source. ``scored``: source, occurrence_id, alias, timestamp_s, score, ``positive``."""
    keys = [source, "occurrence_id", "alias"]
    found = promote(scored, keys, strong, weak, gap).join(scored.groupBy(*keys).agg(F.bool_or(positive).alias("_p")), keys).filter("_p")
    per_source = found.groupBy(source, "alias").agg(F.count(F.lit(1)).alias("n"), F.count_if("promoted").alias("hit"))
    totals = per_source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found_occurrences"), F.count(F.lit(1)).alias("sources"), F.count_if(F.col("hit") > 0).alias("found_sources"))
    return totals.withColumn("occurrence_recall", F.try_divide("found_occurrences", "occurrences")).withColumn("source_recall", F.try_divide("found_sources", "sources"))


def rates(counts: DataFrame, per: str, hours: str) -> DataFrame:
    """Candidates per query and hour; null unless every source has its duration."""
    return counts.agg(F.when(F.count(hours) == F.count(F.lit(1)), F.try_divide(F.sum(per), F.sum(hours))).alias("rate"))


def presence(truth: DataFrame, hits: DataFrame, name: str, verified: Column) -> DataFrame:
    """Each true name as found, needs_review or not_found. ``hits``: name and what ``verified`` reads."""
    per = hits.groupBy(name).agg(F.bool_or(verified).alias("_v"), F.count(F.lit(1)).alias("hits"))
    return truth.join(per, name, "left").select(name, F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("_v"), "found").when(F.col("hits") > 0, "needs_review").otherwise("not_found").alias("outcome"))


def presence_bounds(outcomes: DataFrame, false_hits: int = 0) -> DataFrame:
    """Recall, precision and F1 if all, or none, of the open reviews are true."""
    n = outcomes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "found").alias("lo"), F.count_if(F.col("outcome").isin("found", "needs_review")).alias("hi"))
    rows = n.select("n", F.explode(F.array(F.struct(F.lit("lower").alias("bound"), F.col("lo").alias("tp"), (F.col("hi") - F.col("lo") + false_hits).alias("fp")), F.struct(F.lit("upper").alias("bound"), F.col("hi").alias("tp"), F.lit(false_hits).cast("long").alias("fp")))).alias("b"))
    recall, precision = F.try_divide("b.tp", "n"), F.try_divide("b.tp", F.col("b.tp") + F.col("b.fp"))
    f1 = F.try_divide(2 * recall * precision, recall + precision)
    return rows.select("b.bound", "b.tp", (F.col("n") - F.col("b.tp")).alias("fn"), "b.fp", F.bround(recall, 4).alias("recall"), F.bround(precision, 4).alias("precision"), F.bround(f1, 4).alias("f1"))


def role_flags(events: DataFrame, roles: dict[str, Column], extra: list[str]) -> DataFrame:
    """name with a flag for every role it occurs in, and the universal test that all of its rows satisfy ``only``."""
    parts = [events.select(v.alias("name"), F.lit(k).alias("role"), *extra) for k, v in roles.items()]
    rows = reduce(DataFrame.unionByName, parts).filter("name is not null")
    return rows.groupBy("name").agg(*[F.bool_or(F.col("role") == k).alias(f"is_{k}") for k in roles], *[F.every(c).alias(f"all_{c}") for c in extra], F.count(F.lit(1)).alias("n"))


def leaking_sources(manifest: DataFrame, source: str, split: str) -> DataFrame:
    """Sources in more than one split."""
    return manifest.groupBy(source).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")
