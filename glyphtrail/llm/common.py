"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* an operator selects the columns it needs by name first, so further columns of the
  input, whatever their names, neither clash nor travel through a shuffle;
* a null text is an empty text unless the operator's docstring says otherwise;
* intermediate tables are written below ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import discard, materialize  # noqa: F401

#: Text bytes that a vectorised pass holds at a time, a single longer text excepted.
SLICE_BYTES = 1 << 21

WORD = rb"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not at some later collection of the driver's garbage."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``docs`` has it (names do not differ by case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key() -> Column:
    """128 bits of doc_id and text, either of which may be null: equal for repeated rows only."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string"), F.lit("\u0000"))) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def utf8_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column and the n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The odd multiplier's inverse modulo 2^64, to shift a polynomial prefix sum back.
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_POWERS.get("up", ()))
    if have < n:
        size = max(n, 2 * have, 1 << 16)
        for name, base in (("up", _ODD), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of each text, in order.

    Words are runs of bytes other than space, tab, line and form feeds, never across texts; only
    A-Z are lower-cased. Returns the hashes, the n + 1 offsets of each text's words, and each
    word's first byte.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets), starts


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, repeats included, and their offsets.

    A text of one to k - 1 words has one shingle, the whole sequence; one without words has none.
    """
    counts = np.diff(at)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate(([0], np.cumsum(sizes)))
    total = int(out_at[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out_at
    row = np.repeat(np.arange(len(counts)), sizes)
    begin = at[:-1][row] + np.arange(total) - out_at[:-1][row]
    have = np.minimum(counts[row], k)
    out = have.astype(np.uint64)
    for j in range(k):
        use = j < have
        w = words[np.minimum(begin + j, len(words) - 1)]
        out = np.where(use, mix64(out * _ODD + w), out)
    return out, out_at


def bucketed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """Add the rank from 0 of each row among the rows of equal ``keys`` (none: of all rows).

    Rows are ordered by ``bucket``, then by ``order``, which must refine it. Only the rows of one bucket
    meet in a task, so one key may hold any share of the rows; the offsets come from a small table of counts.
    """
    rows = df.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)
    out = ranked.join(counts.drop("_n"), part)
    return out.withColumn(name, F.col("_before") + F.col("_at")).drop("_bucket", "_before", "_at")
