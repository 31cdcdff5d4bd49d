"""Table upkeep as join rewrites: upserts, cascades, references, compaction. Plain Parquet has no MERGE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def references(tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """path: every distinct path that some column of some table refers to."""
    parts = [t.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("path")) for t, cols in tables]
    return reduce(DataFrame.unionByName, parts).filter("path is not null").distinct()


def orphans(listing: DataFrame, refs: DataFrame) -> DataFrame:
    """Listed paths that nothing refers to. Null paths are no paths, so that the anti join is not null-aware."""
    return listing.filter("path is not null").join(refs, "path", "left_anti")


#: Where the engine keeps its evidence, as a relative path of two parts.
EVIDENCE = "report/assets"


def is_owned(path: Column, temporary: bool = False) -> Column:
    """A relative path of four parts below EVIDENCE that the engine itself wrote; with ``temporary`` also such a name with a draft's ending."""
    draft = r"(\.[0-9a-f]{32}\.tmp)?" if temporary else ""
    return F.coalesce(path.rlike(rf"\A{EVIDENCE}/[0-9a-f]{{16}}-[0-9a-f]{{32}}/\d+-(row\.png|frame\.jpg){draft}\z"), F.lit(False))


def prunable(listing: DataFrame, refs: DataFrame, temporary: bool = False) -> DataFrame:
    """Owned paths of ``listing`` (path) that ``refs`` (path) does not hold."""
    return orphans(listing.filter(is_owned(F.col("path"), temporary)), refs)


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """New descriptions of sources; id, local_path and managed_download stay, and status and error change only from pending or skipped."""
    open_ = F.col("o.status").isin("pending", "skipped")
    kept = {c: F.when(open_, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in ("status", "error")}
    return upsert(old, new, "id", kept | {c: F.col(f"o.{c}") for c in ("local_path", "managed_download")})


def updated(rows: DataFrame, key: str, value: object, **values: object) -> DataFrame:
    """``rows`` with some columns of the row(s) of one key set to new values."""
    hit = F.col(key) == F.lit(value)
    return rows.withColumns({c: F.when(hit, F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def without_parents(rows: DataFrame, key: str, children: DataFrame, child_key: str) -> DataFrame:
    """The rows that some child still refers to: runs without a scan leave, shared ones stay."""
    return rows.join(children.select(F.col(child_key).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_semi")


def append_chunks(old: DataFrame, new: DataFrame, keys: list[str], bounds: list[str]) -> DataFrame:
    """``old`` and the chunks of ``new`` that it lacks; a chunk that is there must have the bounds it had."""
    was = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in bounds])
    rows = new.dropDuplicates(keys).join(was.withColumn("_old", F.lit(True)), keys, "left")
    same = F.lit(True)
    for c in bounds:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    checked = F.when(F.col("_old").isNull(), F.lit(True)).when(same, F.lit(False)).otherwise(F.raise_error(F.lit("a chunk's bounds have changed")).cast("boolean"))
    return old.unionByName(rows.filter(checked).select(old.columns))


def cascade(children: dict[str, tuple[DataFrame, str]], removed: DataFrame) -> dict[str, DataFrame]:
    """Each child without the rows whose parent key is in ``removed`` (key)."""
    return {name: t.join(removed.select(F.col("key").alias(key)), key, "left_anti") for name, (t, key) in children.items()}


def upsert(old: DataFrame, new: DataFrame, key: str, kept: dict[str, Column] | None = None) -> DataFrame:
    """Rows of either side; where both have the key, new values win except in the columns of ``kept``.

    ``kept`` gives the value for such a column from o.<column> and n.<column>.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    found, given = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    out = []
    for c in old.columns:
        value = F.when(found & given, (kept or {}).get(c, F.col(f"n.{c}"))).when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append(value.alias(c))
    return both.select(*out)


def append_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)


def latest_event(log: DataFrame, key: str, order: str) -> DataFrame:
    """Current state from an append-only log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in rest])


def compact_evidence(observations: DataFrame, representatives: DataFrame, path: str, changed: DataFrame | None = None) -> DataFrame:
    """Clear the path of observations that represent no cluster; with ``changed`` (cluster_id) only in those clusters."""
    reps = representatives.select(F.col("observation_id").alias("_rep")).filter("_rep is not null").distinct()
    rows = observations.join(reps, F.col("observation_id") == F.col("_rep"), "left")
    clear = F.col("_rep").isNull()
    if changed is not None:
        rows = rows.join(changed.select("cluster_id").distinct().withColumn("_c", F.lit(True)), "cluster_id", "left")
        clear &= F.col("_c").isNotNull()
    return rows.withColumn(path, F.when(~clear, F.col(path))).select(*observations.columns)


def broken_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def grow(rows: DataFrame, copies: int, keys: list[str], shifts: dict[str, float] | None = None) -> DataFrame:
    """``copies`` clones with suffixed string keys and shifted times."""
    out = rows.crossJoin(rows.sparkSession.range(copies).select(F.col("id").cast("int").alias("copy_no")))
    for k in keys:
        out = out.withColumn(k, F.concat(F.col(k).cast("string"), F.lit("#"), F.col("copy_no").cast("string")))
    for c, by in (shifts or {}).items():
        out = out.withColumn(c, F.col(c) + F.col("copy_no") * by)
    return out
