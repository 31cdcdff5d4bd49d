"""What is done with a corpus: ask for a name, review, report, delete a source, prune evidence, import older rows. Each is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import maintenance, matching, reports, selection
from ..settings import settings
from ..sources.corpus import Corpus

#: The columns that refer to evidence files.
REFERENCES = {"text_clusters": ["evidence_path", "frame_path"], "observations": ["crop_path"], "sampled_frames": ["full_frame_path"]}


def selected_clusters(corpus: Corpus, scan_id: int | None = None, run_id: int | None = None) -> DataFrame:
    scans = selection.select_scans(corpus.read("video_scans"), scan_id, run_id).select(F.col("id").alias("video_scan_id"))
    return corpus.read("text_clusters").join(scans, "video_scan_id", "left_semi")


def support(corpus: Corpus, clusters: DataFrame) -> DataFrame:
    """cluster_id, observation_id, timestamp_s and the observation's columns, of all ``clusters`` (id) at once."""
    frames = corpus.read("sampled_frames").select(F.col("id").alias("sampled_frame_id"), "timestamp_s", "full_frame_path")
    seen = corpus.read("observations").withColumnRenamed("id", "observation_id").join(frames, "sampled_frame_id")
    bridge = corpus.read("cluster_observations").select("cluster_id", "observation_id", "support_score")
    return bridge.join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").join(seen, "observation_id")


def run_query(corpus: Corpus, target: str, aliases: list[str] | None = None, scan_id: int | None = None, run_id: int | None = None, matching_settings: dict | None = None) -> str:
    """Ask the selected clusters for a name; the query's id. Hits elsewhere stay, those of selected clusters are replaced; reviews are a table of their own and stay.

    The scores are computed once and kept while the three tables are written from them.
    """
    asked = settings({"matching": matching_settings or {}})["matching"]
    names, key, version = matching.query_identity(target, list(aliases or []), asked)
    spark, clusters = corpus.spark, selected_clusters(corpus, scan_id, run_id)
    table = matching.alias_table(spark, names, min(matching.BORDERLINE, asked["weak"]))
    rows = support(corpus, clusters).select("cluster_id", "observation_id", "timestamp_s", "raw_text")
    scored = matching.score_aliases(rows, table, asked["short_name_length"]).persist()
    try:
        found = matching.hits(scored, asked["strong"], asked["weak"], asked["gap_s"]).withColumn("query_id", F.lit(key))
        near = matching.borderline(scored).select(F.lit(key).alias("query_id"), "observation_id", F.col("alias").alias("matched_alias"), F.col("score").alias("match_score")).distinct()
        mine = spark.createDataFrame([(key, target, names, version)], "id string, target_name string, aliases array<string>, matcher_version string")
        chosen = clusters.select(F.col("id").alias("cluster_id")).withColumn("query_id", F.lit(key))
        old = corpus.read("hits")
        corpus.commit({
            "queries": maintenance.append_absent(corpus.read("queries"), mine, ["id"]),
            "query_matches": maintenance.replace_rows(corpus.read("query_matches"), near, ["query_id", "observation_id", "matched_alias"]),
            "hits": old.join(chosen, ["cluster_id", "query_id"], "left_anti").select(old.columns).unionByName(found.select(old.columns)),
        })
    finally:
        scored.unpersist()
    return key


def review(corpus: Corpus, cluster_id: int, query_id: str, status: str, note: str | None = None) -> None:
    """Append a review of a hit; an unknown hit is an error."""
    hit = corpus.read("hits").filter((F.col("cluster_id") == cluster_id) & (F.col("query_id") == query_id))
    if hit.isEmpty():
        raise KeyError(f"no hit of cluster {cluster_id} for query {query_id}")
    row = hit.select("cluster_id", "query_id", F.lit(status).alias("review_status"), F.lit(note).cast("string").alias("reviewer_note"), F.current_timestamp().alias("at"))
    corpus.commit({"reviews": corpus.read("reviews").unionByName(row)})


def hit_records(corpus: Corpus, query_id: str | None = None, scan_id: int | None = None, run_id: int | None = None) -> DataFrame:
    """The hits of the selected clusters with everything a report shows, in its order."""
    clusters = selected_clusters(corpus, scan_id, run_id)
    hits = corpus.read("hits").drop("observation_id")
    hits = matching.with_reviews(hits if query_id is None else hits.filter(F.col("query_id") == query_id), corpus.read("reviews"), ["cluster_id", "query_id"])
    seen = support(corpus, clusters)
    matches = corpus.read("query_matches").select("query_id", "observation_id", F.col("matched_alias").alias("alias"), F.col("match_score").alias("score"))
    hits = hits.join(reports.matched_observations(matches, seen, hits), ["query_id", "cluster_id"], "left")
    of = clusters.select(F.col("id").alias("cluster_id"), F.col("video_scan_id").alias("scan_id"), "start_s", "end_s", "representative_observation_id", F.col("evidence_path").alias("representative_path"), F.col("canonical_text").alias("representative_text"), "evidence_timestamp_s", "frame_path", "close_reason")
    scans = corpus.read("video_scans").select(F.col("id").alias("scan_id"), F.col("scan_run_id").alias("run_id"), F.col("video_id").alias("source_id"))
    runs = corpus.read("scan_runs").select(F.col("id").alias("run_id"), "config_hash", "config_json")
    sources = corpus.read("videos").select(F.col("id").alias("source_id"), "title", "source_url")
    queries = corpus.read("queries").select(F.col("id").alias("query_id"), "target_name", "matcher_version")
    texts = seen.join(hits.select("cluster_id").distinct(), "cluster_id", "left_semi")
    rows = reports.with_evidence(hits.join(of, "cluster_id"), corpus.read("observations").withColumnRenamed("id", "observation_id").join(corpus.read("sampled_frames").select(F.col("id").alias("sampled_frame_id"), "timestamp_s", "full_frame_path"), "sampled_frame_id"))
    rows = rows.join(reports.ocr_strings(texts), "cluster_id", "left").withColumn("schema_version", F.lit(reports.SCHEMA_VERSION))
    place = rows.columns
    rows = reports.hit_report(rows.select("cluster_id", "query_id", *[c for c in place if c not in ("cluster_id", "query_id", "start_s", "end_s", "scan_id")]), of.select("cluster_id", "scan_id", "start_s", "end_s"), sources, queries, scans, runs)
    from ..functions.text import timestamp_url

    return rows.withColumn("timestamp_url", timestamp_url(F.col("source_url"), F.col("start_s")))


def cluster_records(corpus: Corpus, scan_id: int | None = None, run_id: int | None = None) -> DataFrame:
    """The selected clusters with their observations, sources and runs, in the export's order."""
    clusters = selected_clusters(corpus, scan_id, run_id)
    seen = support(corpus, clusters).select("cluster_id", "observation_id", "timestamp_s", "raw_text", F.col("quad").alias("polygon"), "screen_region", "detector_confidence", "ocr_confidence", "crop_path", "sampled_frame_id", "full_frame_path", "support_score")
    scans = corpus.read("video_scans").select(F.col("id").alias("scan_id"), F.col("scan_run_id").alias("run_id"), F.col("video_id").alias("source_id"), "status")
    sources = corpus.read("videos").select(F.col("id").alias("source_id"), "source_url", "title", "channel_id")
    quads = corpus.read("observations").select(F.col("id").alias("representative_observation_id"), F.col("quad").alias("representative_polygon"))
    own = clusters.withColumnsRenamed({"id": "cluster_id", "video_scan_id": "scan_id"}).join(quads, "representative_observation_id", "left")
    return reports.cluster_export(own, sources, scans, corpus.read("scan_runs").withColumnRenamed("id", "run_id"), seen)


def references(corpus: Corpus, version: int | None = None) -> DataFrame:
    return maintenance.references([(corpus.read(t, version), cols) for t, cols in REFERENCES.items()])


def delete_source(corpus: Corpus, source_id: str) -> int:
    """Delete a source with all that hangs on it; runs that other sources share stay. Rows are committed before files are unlinked; how many were."""
    gone = corpus.get("videos", "id", source_id).select(F.col("id").alias("key"))
    kept = {"videos": corpus.read("videos").filter(F.col("id") != source_id)}
    # From parents to children: each child goes by the keys that its parent has lost.
    for child, column, parent in (("video_scans", "video_id", None), ("scan_chunks", "video_scan_id", "video_scans"), ("sampled_frames", "video_scan_id", "video_scans"), ("text_clusters", "video_scan_id", "video_scans"), ("observations", "sampled_frame_id", "sampled_frames"), ("cluster_observations", "cluster_id", "text_clusters"), ("hits", "cluster_id", "text_clusters"), ("reviews", "cluster_id", "text_clusters"), ("query_matches", "observation_id", "observations"), ("chunk_attempts", "chunk_id", "scan_chunks")):
        lost = gone if parent is None else corpus.read(parent).select(F.col("id").alias("key")).join(kept[parent].select(F.col("id").alias("key")), "key", "left_anti")
        kept[child] = maintenance.cascade({child: (corpus.read(child), column)}, lost)[child].select(corpus.read(child).columns)
    kept["scan_runs"] = maintenance.without_parents(corpus.read("scan_runs"), "id", kept["video_scans"], "scan_run_id").select(corpus.read("scan_runs").columns)
    corpus.commit(kept)
    return prune(corpus)


def prune(corpus: Corpus, paths: DataFrame | None = None) -> int:
    """Unlink owned evidence that the newest version does not refer to: of ``paths`` (path), or all that lies there, drafts included; how many files."""
    listing = corpus.files(maintenance.EVIDENCE) if paths is None else paths.select("path").distinct()
    return corpus.unlink(maintenance.prunable(listing, references(corpus), temporary=paths is None))


def removable_downloads(sources: DataFrame, folder: str) -> DataFrame:
    """local_path of finished sources whose file the engine fetched itself, into its own folder."""
    inside = F.col("local_path").startswith(folder.rstrip("/") + "/") & ~F.col("local_path").rlike(r"(^|/)\.\.(/|$)")
    return sources.filter((F.col("status") == "scanned") & F.col("managed_download") & F.coalesce(inside, F.lit(False))).select("id", "local_path")


def import_rows(videos: DataFrame, clusters: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """Tables of a corpus from an older one's rows: a run, a scan and a chunk for each source, a frame for each of its times.

    ``videos``: id, scanned_at, config_hash, status; ``clusters``: id, video_id, start_s, end_s, canonical_text, evidence_timestamp_s, row_index, evidence_path,
    frame_path; ``observations``: id, video_id, cluster_id, timestamp_s, row_index, raw_text, ocr_confidence, crop_path. A cluster's representative is the
    observation at its evidence's time and row, if there is exactly one. Numbers are ranks by content, so that a repeated import gives the same.
    """
    from pyspark.sql import Window

    used = videos.join(clusters.select(F.col("video_id").alias("id")).distinct().withColumn("_has", F.lit(True)), "id", "left").filter(F.col("_has") | (F.col("status") == "scanned"))
    # One row a source: a table that is small beside its observations.
    numbered = used.withColumn("scan", F.row_number().over(Window.orderBy("id")).cast("long"))
    scan_of = numbered.select(F.col("id").alias("video_id"), F.col("scan").alias("video_scan_id"))
    at = F.col("scanned_at").cast("timestamp")
    seen = observations.join(scan_of, "video_id")
    times = seen.select("video_scan_id", "timestamp_s").distinct()
    frame_id = F.xxhash64("video_scan_id", "timestamp_s").bitwiseAND(0x7FFFFFFFFFFFFFFF)
    marks = clusters.select(F.col("id").alias("cluster_id"), F.col("evidence_timestamp_s").alias("timestamp_s"), "row_index", "evidence_path", "frame_path")
    chosen = seen.select("cluster_id", "timestamp_s", "row_index", F.col("id").alias("observation_id"), "video_scan_id").join(marks, ["cluster_id", "timestamp_s", "row_index"])
    only = chosen.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in ("observation_id", "video_scan_id", "timestamp_s", "evidence_path", "frame_path")]).filter("n = 1")
    shown = only.groupBy("video_scan_id", "timestamp_s").agg(F.max("frame_path").alias("full_frame_path"))
    crops = only.groupBy(F.col("observation_id").alias("id")).agg(F.max("evidence_path").alias("evidence"))
    return {
        "videos": videos.select("id", "status"),
        "scan_runs": numbered.select(F.col("scan").alias("id"), at.alias("completed_at"), F.lit("completed").alias("status"), F.lit(True).alias("legacy"), F.coalesce("config_hash", F.lit("legacy:unknown")).alias("config_hash")),
        "video_scans": numbered.select(F.col("scan").alias("id"), F.col("scan").alias("scan_run_id"), F.col("id").alias("video_id"), F.lit("completed").alias("status")),
        "scan_chunks": numbered.select(F.col("scan").alias("id"), F.col("scan").alias("video_scan_id"), F.lit(0).cast("long").alias("sequence_no"), F.lit("completed").alias("status"), F.lit(0.0).alias("chunk_start_s")),
        "sampled_frames": times.select(frame_id.alias("id"), "video_scan_id", F.concat(F.lit("legacy:"), F.col("timestamp_s").cast("string")).alias("sample_key"), "timestamp_s").join(shown, ["video_scan_id", "timestamp_s"], "left"),
        "observations": seen.join(crops, "id", "left").select("id", frame_id.alias("sampled_frame_id"), F.concat(F.lit("legacy:"), F.col("id").cast("string")).alias("geometry_key"), "raw_text", "ocr_confidence", F.col("evidence").alias("crop_path")),
        "text_clusters": clusters.join(scan_of, "video_id").join(only.select(F.col("cluster_id").alias("id"), F.col("observation_id").alias("representative_observation_id")), "id", "left").select("id", "video_scan_id", "start_s", "end_s", "representative_observation_id", "canonical_text", F.lit("legacy-unknown").alias("close_reason"), "evidence_path", "frame_path", "evidence_timestamp_s"),
        "cluster_observations": seen.filter("cluster_id is not null").select("cluster_id", F.col("id").alias("observation_id"), "video_scan_id", F.lit(1.0).alias("support_score")),
    }


def import_into(corpus: Corpus, videos: DataFrame, clusters: DataFrame, observations: DataFrame) -> int:
    """Commit :func:`import_rows`, if the new tables have as many clusters and observations as the old ones."""
    from ..sources.corpus import SCHEMAS

    tables = import_rows(videos, clusters, observations)
    counts = reports.reconciled({"text_clusters": (clusters, tables["text_clusters"]), "observations": (observations, tables["observations"])})
    wrong = [r["name"] for r in counts.collect() if not r["equal"]]
    if wrong:
        raise ValueError(f"imported counts differ: {', '.join(sorted(wrong))}")
    spark = corpus.spark
    return corpus.commit({n: spark.createDataFrame([], SCHEMAS[n]).unionByName(t, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[n]]) for n, t in tables.items()})
