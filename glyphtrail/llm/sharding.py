"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order and given their fractional rank (r - 0.5) / n. Sorted by that
fraction, the sources are interleaved in proportion, so every contiguous cut has the corpus's mixture; cutting
at multiples of N / shards keeps the row counts at most one apart.

All of it is DataFrame operations over narrow rows: the text is read once, for its size and checksum, and is
never shuffled. Ranks come from :func:`common.bucketed_rank`, so a source that holds a third of all rows is
sorted in 4,096 pieces like the others.

Edge cases: a null text counts as empty; a null source is a stratum of its own; repeated rows are separate
rows in an order that does not depend on the partitioning; an empty table gives an empty result; with fewer
rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed_rank, materialize, table

SHARDS, SEED, BUCKETS = 8, 20240501, 4096


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, stratum: str = "source") -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text, ``stratum``) to a shard and a slot in it.

    Returns doc_id, size, text_crc32, stratum, fraction, shard, slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.when(F.col(stratum).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(stratum).cast("string"))).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256).alias("_h"),
    )
    ties = [F.col(c) for c in ("_h", "doc_id", "text_crc32", "size")]
    ranked = bucketed_rank(rows, ["stratum"], F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"), ties, "_rank", "_total")
    ranked = materialize(ranked.withColumn("fraction", (F.col("_rank") + 0.5) / F.col("_total")).drop("_rank", "_total"), "shards")
    placed = bucketed_rank(ranked, [], F.floor(F.col("fraction") * BUCKETS), [F.col("fraction"), F.col("stratum"), *ties], "_g", "_all")
    shard = F.floor(F.expr(f"_g * {shards} div _all")).cast("int")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "stratum", "fraction", "shard", F.expr(f"_g - (cast(shard as bigint) * _all + {shards - 1}) div {shards}").alias("slot")
    )


def op2_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a shard and slot under law `rows`. Edge cases: see :mod:`sharding`."""
    placed = interleave(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.substring("stratum", 2, 1 << 30).alias("source"), "fraction")
