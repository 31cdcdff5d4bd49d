"""A versioned corpus of Parquet tables: a commit writes new directories and then swaps one manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 6
_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_QUAD = T.ArrayType(T.StructType([T.StructField("x", _D), T.StructField("y", _D)]))


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "videos": _table(id=_S, source_url=_S, channel_id=_S, title=_S, upload_date=_S, duration_s=_D, resolution=_L, local_path=_S, managed_download=_B, status=_S, error=_S),
    "scan_runs": _table(id=_L, started_at=T.TimestampType(), completed_at=T.TimestampType(), status=_S, legacy=_B, config_hash=_S, config_json=_S),
    "video_scans": _table(id=_L, scan_run_id=_L, video_id=_S, status=_S, error=_S, sample_fps=_D),
    "scan_chunks": _table(id=_L, video_scan_id=_L, sequence_no=_L, status=_S, chunk_start_s=_D, chunk_end_s=_D, last_processed_timestamp_s=_D),
    "chunk_attempts": _table(chunk_id=_L, attempt_no=_L, error=_S, elapsed_s=_D),
    "sampled_frames": _table(id=_L, video_scan_id=_L, sample_key=_S, timestamp_s=_D, full_frame_path=_S),
    "observations": _table(id=_L, sampled_frame_id=_L, quad=_QUAD, geometry_key=_S, screen_region=_S, detector_confidence=_D, raw_text=_S, normalized_text=_S, compact_text=_S, ocr_confidence=_D, crop_path=_S),
    "text_clusters": _table(id=_L, video_scan_id=_L, start_s=_D, end_s=_D, representative_observation_id=_L, canonical_text=_S, best_confidence=_D, support_count=_L, close_reason=_S, evidence_path=_S, frame_path=_S, evidence_timestamp_s=_D),
    "cluster_observations": _table(cluster_id=_L, observation_id=_L, video_scan_id=_L, support_score=_D),
    "queries": _table(id=_S, target_name=_S, aliases=T.ArrayType(_S), matcher_version=_S),
    "query_matches": _table(query_id=_S, observation_id=_L, matched_alias=_S, match_score=_D),
    "hits": _table(cluster_id=_L, query_id=_S, matched_alias=_S, best_text=_S, best_score=_D, support_count=_L, observation_id=_L),
    "reviews": _table(cluster_id=_L, query_id=_S, review_status=_S, reviewer_note=_S, at=T.TimestampType()),
}
STATUSES = {"videos": ("pending", "skipped", "processing", "scanned", "failed"), "video_scans": ("running", "completed", "failed"), "reviews": ("unreviewed", "confirmed", "rejected")}


class Corpus:
    """Tables below ``root``. Readers pin a version; a version appears whole or not at all.

    All file access goes through Hadoop's file system, so ``root`` may be any store that Spark reads. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if not version:
            return {"version": 0, "schema": SCHEMA_VERSION, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        out = json.loads(text)
        if out["schema"] > SCHEMA_VERSION:
            raise ValueError(f"schema {out['schema']} is newer than {SCHEMA_VERSION}")
        return out

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version; columns that an older schema lacked are null."""
        empty = self.spark.createDataFrame([], SCHEMAS[name]) if name in SCHEMAS else None
        path = self.manifest(version)["tables"].get(name)
        if path is None:
            if empty is None:
                raise KeyError(name)
            return empty
        rows = self.spark.read.parquet(f"{self.root}/{path}")
        return empty.unionByName(rows, allowMissingColumns=True) if empty is not None and set(rows.columns) != set(empty.columns) else rows

    def get(self, name: str, key: str, value: object) -> DataFrame:
        rows = self.read(name).filter(F.col(key) == F.lit(value))
        if rows.isEmpty():
            raise KeyError(f"{name}: no {key} {value!r}")
        return rows

    def sql(self, text: str, version: int | None = None, **args: object) -> DataFrame:
        """A query over the corpus's tables, which it names as {videos} and so on, with :named parameters."""
        tables = {n: self.read(n, version) for n in {*SCHEMAS, *self.manifest(version)["tables"]} if f"{{{n}}}" in text}
        return self.spark.sql(text, args=args or None, **tables)

    def backup(self, root: str, version: int | None = None) -> Corpus:
        """A version's tables as a corpus of its own."""
        other = Corpus(self.spark, root)
        other.commit({name: self.read(name, version) for name in self.manifest(version)["tables"]})
        return other

    def files(self, folder: str) -> DataFrame:
        """path: the files below ``folder``, relative to the root."""
        base = self._path(f"{self.root}/{folder}")
        found: list[tuple[str]] = []
        if self._fs.exists(base):
            whole = str(self._fs.getFileStatus(self._path(self.root)).getPath())
            at = self._fs.listFiles(base, True)
            while at.hasNext():
                found.append((str(at.next().getPath())[len(whole) + 1 :],))
        return self.spark.createDataFrame(found, "path string")

    def write_text(self, path: str, text: str) -> None:
        """A file that appears whole: a draft beside it takes its name when it is written."""
        target = self._path(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        draft = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = files.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        files.delete(target, False)
        if not files.rename(draft, target):
            raise RuntimeError(f"{path} was not written")

    def unlink(self, paths: DataFrame) -> int:
        """Deletes files given by relative path (path), one at a time as they come; how many were there."""
        return sum(bool(self._fs.delete(self._path(f"{self.root}/{r['path']}"), False)) for r in paths.toLocalIterator())

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes the tables under new names and publishes them together as the next version."""
        now = self.manifest()
        paths = dict(now["tables"])
        for name, rows in tables.items():
            for table, allowed in STATUSES.items():
                if name == table:
                    column = "review_status" if table == "reviews" else "status"
                    rows = rows.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{name}.{column}: "), F.coalesce(F.col(column), F.lit("null"))))))
            paths[name] = f"data/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{paths[name]}")
        version = now["version"] + 1
        # Created with overwriting refused, which stores without an atomic rename keep as well; a reader that meets a part of it fails to parse it.
        final = self._path(f"{self.root}/manifests/{version}.json")
        try:
            out = self._fs.create(final, False)
        except Exception as e:
            raise RuntimeError(f"version {version} was published by another writer") from e
        out.write(bytearray(json.dumps({"version": version, "schema": SCHEMA_VERSION, "tables": paths}).encode()))
        out.close()
        return version
