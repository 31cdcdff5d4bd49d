"""Readers and sinks of JSON lines, nested documents, hashed files and reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import leaking_sources

MANIFEST = "image string, source_id string, visible_names array<string>, text string, occurrence_id string, timestamp_s double, split string, hud string, resolution string, compression string, crowded boolean, source_duration_s double"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows; required fields must be there, and no source may be in two splits."""
    rows = spark.read.schema(MANIFEST).json(path)
    if not rows.filter("image is null or source_id is null or visible_names is null").isEmpty():
        raise ValueError("image, source_id and visible_names are required")
    if not leaking_sources(rows, "source_id", "split").isEmpty():
        raise ValueError("a source is in more than one split")
    return rows


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(deaths, users) of a parsed game document: events by tick with ids, and the names of the ids."""
    doc = spark.read.option("multiLine", True).schema("header struct<interval_per_tick:double>, users map<string,struct<name:string>>, deaths array<struct<tick:bigint,killer:int,victim:int,assister:int,weapon:string>>").json(path)
    deaths = doc.select("header.interval_per_tick", F.explode("deaths").alias("d")).select("d.*", F.round(F.col("d.tick") * F.col("interval_per_tick"), 3).alias("seconds"))
    users = doc.select(F.explode("users").alias("id", "u")).select(F.col("id").cast("int").alias("id"), F.col("u.name").alias("name"))
    return deaths, users


def named(deaths: DataFrame, users: DataFrame, column: str) -> DataFrame:
    """Adds <column>_name; id 0 is the world (null), any other id must be known."""
    rows = deaths.join(F.broadcast(users.select(F.col("id").alias(column), F.col("name").alias(f"{column}_name"))), column, "left")
    known = (F.col(column) == 0) | F.col(column).isNull() | F.col(f"{column}_name").isNotNull()
    return rows.withColumn(f"{column}_name", F.when(known, F.col(f"{column}_name")).otherwise(F.raise_error(F.concat(F.lit("unknown user "), F.col(column).cast("string")))))


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files, read in the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def nested_clusters(clusters: DataFrame, bridge: DataFrame, observations: DataFrame) -> DataFrame:
    """Each cluster with its observations in time order and their distinct texts. ``bridge``: cluster_id, observation_id, support_score."""
    rows = bridge.join(observations, "observation_id")
    item = F.struct("timestamp_s", "observation_id", "raw_text", "support_score")
    per = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(item)).alias("observations"))
    per = per.withColumn("ocr_strings", F.array_distinct(F.transform("observations", lambda o: o["raw_text"])))
    return clusters.join(per, "cluster_id", "left")


def html_report(hits: DataFrame, columns: list[str], title: str) -> str:
    """A page with one table row for each hit, streamed to the driver one partition at a time."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    rows = [f"<tr>{''.join(f'<td>{html.escape(str(r[c] if r[c] is not None else ""))}</td>' for c in columns)}</tr>" for r in hits.select(*columns).toLocalIterator()]
    body = f"<table><thead><tr>{head}</tr></thead><tbody>{''.join(rows)}</tbody></table>" if rows else "<p>No hits.</p>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"
