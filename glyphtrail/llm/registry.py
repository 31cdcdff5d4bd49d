"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .decontamination import op3_decontamination
from .fingerprints import op10_edit_fingerprints
from .html import op4_main_text
from .langid import op8_language_id
from .neardup import op6_near_duplicates
from .packing import op9_packed_sequences
from .quality import op1_quality
from .sharding import op2_interleaved_shards
from .substrings import op5_repeated_substrings
from .toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_interleaved_shards,
        op3_decontamination,
        op4_main_text,
        op5_repeated_substrings,
        op6_near_duplicates,
        op7_toxicity,
        op8_language_id,
        op9_packed_sequences,
        op10_edit_fingerprints,
    )
}

#: Scores, extraction and tokenization are beyond SQL; the tests hold those queries against brute force.
ORACLES: dict[str, str] = {
    "op2_interleaved_shards": oracles.SHARDING,
    "op5_repeated_substrings": oracles.SUBSTRINGS,
    "op6_near_duplicates": oracles.NEAR_DUPLICATES,
}
