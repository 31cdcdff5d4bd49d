"""A training corpus from raw documents: quality, near duplicates, repeated substrings, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphtrail.llm.common import materialize, table
from glyphtrail.llm.decontamination import drop_contaminated
from glyphtrail.llm.neardup import one_of_each
from glyphtrail.llm.packing import pack
from glyphtrail.llm.quality import keep_good
from glyphtrail.llm.substrings import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", one_of_each),
    ("repeated_substrings", without_repeats),
    ("decontamination", drop_contaminated),
    ("packing", packed),
]

#: SQL can't express language-model scoring, MinHash candidates and tokenization; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
