"""Reports: hits with their evidence, clusters with their observations, presence audits, digests. One join for all rows, never one for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 2


def ocr_strings(support: DataFrame) -> DataFrame:
    """cluster_id, ocr_strings: the distinct texts of each cluster in order of time and id. ``support``: cluster_id, observation_id, timestamp_s, raw_text.

    Repeats are reduced before a cluster is gathered, so a row holds its distinct texts.
    """
    first = support.groupBy("cluster_id", "raw_text").agg(F.min(F.struct("timestamp_s", "observation_id")).alias("at"))
    gathered = first.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("at", "raw_text"))).alias("texts"))
    return gathered.select("cluster_id", F.col("texts.raw_text").alias("ocr_strings"))


def matched_observations(matches: DataFrame, bridge: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, cluster_id, matched_observation_id: the best scored observation of each hit's alias in its cluster, of equal ones the smallest id.

    ``matches``: query_id, observation_id, alias, score; ``bridge``: cluster_id, observation_id; ``hits``: query_id, cluster_id, matched_alias.
    """
    wanted = hits.select("query_id", "cluster_id", F.col("matched_alias").alias("alias"))
    rows = matches.join(bridge.select("cluster_id", "observation_id"), "observation_id").join(wanted, ["query_id", "cluster_id", "alias"])
    return rows.groupBy("query_id", "cluster_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "observation_id"))["observation_id"].alias("matched_observation_id"))


def with_evidence(hits: DataFrame, observations: DataFrame) -> DataFrame:
    """Hits with what shows them: the matched observation where it has a crop, else the representative one, else the cluster's own columns.

    ``hits``: matched_observation_id, representative_observation_id, representative_path, representative_text, evidence_timestamp_s, frame_path and
    others; ``observations``: observation_id, raw_text, crop_path, quad, timestamp_s, full_frame_path.
    """
    of = lambda who: observations.select(F.col("observation_id").alias(f"{who}_observation_id"), F.struct("observation_id", "raw_text", "crop_path", "quad", "timestamp_s", "full_frame_path").alias(f"_{who}"))
    rows = hits.join(of("matched"), "matched_observation_id", "left").join(of("representative"), "representative_observation_id", "left")
    shown = F.col("_matched.crop_path").isNotNull()
    use = F.when(shown, F.col("_matched")).otherwise(F.col("_representative"))
    own = {"evidence_path": ("crop_path", "representative_path"), "evidence_timestamp_s": ("timestamp_s", "evidence_timestamp_s"), "evidence_text": ("raw_text", "representative_text"), "frame_path": ("full_frame_path", "frame_path")}
    some = use["observation_id"].isNotNull()
    out = {
        "matched_timestamp_s": F.col("_matched.timestamp_s"), "matched_polygon": F.col("_matched.quad"), "representative_polygon": F.col("_representative.quad"),
        "matched_crop_path": F.col("_matched.crop_path"), "observation_evidence_available": F.coalesce(shown, F.lit(False)), "evidence_observation_id": use["observation_id"],
        "evidence_kind": F.when(shown, F.lit("matched")).otherwise(F.lit("representative")),
    } | {name: F.when(some, use[field]).otherwise(F.col(fallback)) for name, (field, fallback) in own.items()}
    return rows.withColumns(out).drop("_matched", "_representative")


def hit_report(hits: DataFrame, clusters: DataFrame, sources: DataFrame, queries: DataFrame, scans: DataFrame, runs: DataFrame) -> DataFrame:
    """Every hit with its cluster, source, query, scan and run, best scores first and then by start and cluster.

    Keys: hits.cluster_id, hits.query_id; clusters.source_id, clusters.scan_id; scans.run_id. Sources, queries and runs are small beside
    hits, and whether one is broadcast is left to the optimizer's sizes.
    """
    rows = hits.join(clusters, "cluster_id").join(queries, "query_id").join(scans, "scan_id").join(runs, "run_id").join(sources, "source_id")
    return rows.orderBy(F.col("best_score").desc(), "start_s", "cluster_id")


def cluster_export(clusters: DataFrame, sources: DataFrame, scans: DataFrame, runs: DataFrame, support: DataFrame) -> DataFrame:
    """Clusters by source and start, each with its source's fields, scan_status, run_provenance (a struct), its observations in time order and their texts.

    ``support``: cluster_id, observation_id, timestamp_s, raw_text and whatever an observation is to show.
    """
    rest = [c for c in support.columns if c not in ("cluster_id", "timestamp_s", "observation_id")]
    per = support.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_s", "observation_id", *rest))).alias("observations"))
    texts = F.array_distinct(F.transform("observations", lambda o: o["raw_text"]))
    provenance = runs.select("run_id", F.struct(*runs.columns).alias("run_provenance"))
    rows = clusters.join(scans.withColumnRenamed("status", "scan_status"), "scan_id").join(sources, "source_id").join(provenance, "run_id").join(per, "cluster_id", "left")
    rows = rows.withColumn("ocr_strings", F.coalesce(texts, F.array().cast("array<string>"))).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    return rows.orderBy("source_id", "start_s", "cluster_id")


def evidence_url(path: Column, folder: str = "report") -> Column:
    """A relative path below ``folder``, as the page in that folder links it; empty for anything else (absolute, empty or climbing paths)."""
    safe = path.startswith(f"{folder}/") & ~path.rlike(r"(^|/)\.\.?(/|$)|//|\\")
    return F.when(F.coalesce(safe, F.lit(False)), F.substring(path, len(folder) + 2, 1 << 30)).otherwise("")


def latest_query(queries: DataFrame) -> DataFrame:
    """target_name, query_id: the newest query of each name."""
    return queries.groupBy("target_name").agg(F.max("query_id").alias("query_id"))


def roster_overlap(battery: DataFrame, roster: DataFrame) -> DataFrame:
    """Names of a negative battery that are on the roster after all; the battery is sound when there are none."""
    return battery.select("name").distinct().join(roster.select("name").distinct(), "name", "left_semi")


def battery(names: DataFrame, queries: DataFrame, hits: DataFrame, compact) -> DataFrame:
    """name, candidates, verified, unverified for each of ``names`` (name): the hits of its newest query, and those whose text holds the name in compact form.

    ``queries``: query_id, target_name; ``hits``: query_id, best_text; ``compact`` turns a text column into its compact form. A name
    that was never asked for has none.
    """
    asked = latest_query(queries).withColumnRenamed("target_name", "name")
    found = hits.join(asked, "query_id").select("name", F.contains(compact(F.col("best_text")), compact(F.col("name"))).alias("holds"))
    counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("holds").alias("verified"))
    zero = F.lit(0).cast("long")
    rows = names.select("name").distinct().join(counts, "name", "left")
    return rows.select("name", F.coalesce("candidates", zero).alias("candidates"), F.coalesce("verified", zero).alias("verified"), F.coalesce(F.col("candidates") - F.col("verified"), zero).alias("unverified"))


def battery_summary(rows: DataFrame) -> DataFrame:
    """One row: queries, queries_with_candidates, candidates, verified, unverified."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("candidates") > 0).alias("queries_with_candidates"), total("candidates"), total("verified"), total("unverified"))


def row_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key``, n, digest: a digest of each key's rows that their order plays no part in, as equal rows would be sorted anyway.

    Rows are hashed before the shuffle; a key's sorted hashes are hashed once more.
    """
    cells = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    hashed = rows.select(key, F.sha2(F.concat_ws("\u0001", *cells), 256).alias("h"))
    return hashed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))


def reconciled(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """name, old, new, equal: the row counts of each pair of tables."""
    out = None
    for name, (old, new) in pairs.items():
        sides = old.select(F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(F.lit(0).alias("o"), F.lit(1).alias("n")))
        row = sides.agg(F.coalesce(F.sum("o"), F.lit(0)).cast("long").alias("old"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("new")).select(F.lit(name).alias("name"), "old", "new", (F.col("old") == F.col("new")).alias("equal"))
        out = row if out is None else out.unionByName(row)
    return out


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: the row counts of tables."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
