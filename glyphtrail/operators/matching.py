"""Alias queries: score, promote by temporal consensus, choose the best alias, keep reviews."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import MATCHER_VERSION, alias_score, compact_text, compacted, normalize_text, normalized, pieces

STRONG, WEAK, GAP_S, SHORT_NAME, BORDERLINE = 0.95, 0.82, 3.0, 4, 0.65
#: Names asked for at once; they are broadcast.
MOST_ALIASES = 10_000


def query_identity(target: str, aliases: list[str], settings: dict) -> tuple[list[str], str, str]:
    """Aliases without repeats in their order, a content key, and the versioned matcher name."""
    kept = list(dict.fromkeys([target, *aliases]))
    if any(not compact_text(a) for a in kept):
        raise ValueError("an alias is empty in its compact form")
    canonical = json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    version = f"{MATCHER_VERSION}:{hashlib.sha256(canonical.encode()).hexdigest()[:16]}"
    key = hashlib.sha256(json.dumps([target, sorted(kept), version], ensure_ascii=False).encode()).hexdigest()[:16]
    return kept, key, version


def alias_table(spark: SparkSession, aliases: list[str], cut: float = 0.0) -> DataFrame:
    """The aliases in both forms, and the pieces that a text needs for a score of at least ``cut``."""
    if len(aliases) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    forms = [(i, a, normalize_text(a), compact_text(a)) for i, a in enumerate(aliases)]
    rows = [(*f, pieces(f[2], cut), pieces(f[3], cut)) for f in forms]
    return spark.createDataFrame(rows, "ordinal int, alias string, alias_normal string, alias_compact string, pieces_normal array<string>, pieces_compact array<string>")


def score_aliases(observations: DataFrame, aliases: DataFrame, short_length: int = SHORT_NAME) -> DataFrame:
    """Every observation (with raw_text) and alias with its score, exact from the aliases' cut on.

    The texts are normalized once, before the aliases multiply the rows; at most MOST_ALIASES aliases are broadcast.
    """
    rows = observations.withColumn("_n", normalized(F.col("raw_text"))).withColumn("_c", compacted(F.col("_n")))
    rows = rows.crossJoin(F.broadcast(aliases))
    score = alias_score(F.col("_n"), F.col("_c"), F.col("alias_normal"), F.col("alias_compact"), short_length, (F.col("pieces_normal"), F.col("pieces_compact")))
    return rows.withColumn("score", score).drop("_n", "_c", *(c for c in aliases.columns if c not in ("ordinal", "alias")))


def borderline(scored: DataFrame, least: float = BORDERLINE) -> DataFrame:
    return scored.filter(F.col("score") >= least)


def promote(scored: DataFrame, keys: list[str], strong: float = STRONG, weak: float = WEAK, gap: float = GAP_S) -> DataFrame:
    """Per key: promoted (one strong score, or two weak ones at different times at most ``gap`` apart), support, best score.

    ``scored``: keys, timestamp_s, score. One shuffle by the keys: the adjacent times come from a window over the weak
    rows, whose order a group's aggregation shares.
    """
    per_time = scored.groupBy(*keys, "timestamp_s").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys, F.col("score") >= weak).orderBy("timestamp_s")
    near = (F.col("score") >= weak) & (F.col("timestamp_s") - F.lag("timestamp_s").over(order) <= gap)
    rows = per_time.withColumn("_near", F.coalesce(near, F.lit(False)))
    return rows.groupBy(*keys).agg(
        (F.max("score") >= strong).alias("_strong"), F.bool_or("_near").alias("_pair"), F.count_if(F.col("score") >= weak).alias("support_count"), F.max("score").alias("best_score")
    ).select(*keys, (F.col("_strong") | F.col("_pair")).alias("promoted"), "support_count", "best_score")


def first_best(value: Column, *order: Column) -> Column:
    """Descending ``value``, ties by ``order``: the first maximum of an ordered scan."""
    return F.struct(value.desc(), *order)


def hits(scored: DataFrame, strong: float = STRONG, weak: float = WEAK, gap: float = GAP_S) -> DataFrame:
    """cluster_id, matched_alias, best_text, best_score, support_count, observation_id of every promoted cluster.

    ``scored``: cluster_id, observation_id, timestamp_s, raw_text, ordinal, alias, score, exact from ``weak`` on; it is read once, and
    each time's best row goes along with its score. Of equal scores the earliest observation wins; of equal (score, support) the first
    alias asked for.
    """
    keys = ["cluster_id", "ordinal", "alias"]
    best = F.min(F.struct((-F.col("score")).alias("s"), "observation_id", "raw_text")).alias("best")
    times = scored.filter(F.col("score") >= weak).groupBy(*keys, "timestamp_s").agg(best).withColumn("score", -F.col("best.s"))
    order = Window.partitionBy(*keys).orderBy("timestamp_s")
    near = F.coalesce(F.col("timestamp_s") - F.lag("timestamp_s").over(order) <= gap, F.lit(False))
    first = F.min(F.struct((-F.col("score")).alias("s"), "timestamp_s", F.col("best.observation_id").alias("o"), F.col("best.raw_text").alias("t"))).alias("_b")
    found = times.withColumn("_near", near).groupBy(*keys).agg(first, F.bool_or("_near").alias("_pair"), F.count(F.lit(1)).alias("support_count"))
    found = found.withColumn("best_score", -F.col("_b.s")).filter((F.col("best_score") >= strong) | F.col("_pair"))
    choice = F.min(F.struct((-F.col("best_score")).alias("s"), (-F.col("support_count")).alias("n"), "ordinal", "alias", F.col("_b.t").alias("t"), F.col("_b.o").alias("o"))).alias("_c")
    rows = found.groupBy("cluster_id").agg(choice)
    return rows.select("cluster_id", F.col("_c.alias").alias("matched_alias"), F.col("_c.t").alias("best_text"), (-F.col("_c.s")).alias("best_score"), (-F.col("_c.n")).alias("support_count"), F.col("_c.o").alias("observation_id"))


def with_reviews(found: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Derived hits with the latest human review of each; reviews (keys, review_status, reviewer_note, at) are only appended to."""
    # Of reviews at one time the last status and note by order.
    last = reviews.groupBy(*keys).agg(F.max(F.struct("at", "review_status", "reviewer_note")).alias("_r"))
    return found.join(last, keys, "left").select(*[found[c] for c in found.columns], F.coalesce("_r.review_status", F.lit("unreviewed")).alias("review_status"), F.col("_r.reviewer_note").alias("reviewer_note"))


def rerun(old: DataFrame, new: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Old results outside ``selected`` stay; inside it only what was found anew remains."""
    return old.join(selected, key, "left_anti").unionByName(new)
