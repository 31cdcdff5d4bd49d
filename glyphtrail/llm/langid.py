"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training: character 1- to 3-grams of labelled texts are hashed into ``BUCKETS`` columns and counted per language.
The model may be fitted on a bounded sample: at most about ``TRAIN_DOCS`` texts a language, chosen by a hash of
doc_id. The smoothed log-probability matrix (BUCKETS x languages of float32) is broadcast; its size is fixed by the
two parameters and checked. Scoring is numpy over the bytes of an Arrow batch: one gather of matrix rows per n-gram
and one segmented sum per text, over the whole text.

The score is the posterior of the predicted language, computed from the mean log-likelihood of a character times
``SHARPNESS``, so that it does not saturate at 1 for every longer text.

Edge cases: a text that is null or has no letter is `und` with score 0; with no labelled text every text is `und`;
equal scores go to the first language by name; rows are scored one by one, so groups of copies play no part.
Very long texts are scored in slices whose sums are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8_views

BUCKETS, ORDERS, TRAIN_DOCS, SMOOTHING, SHARPNESS = 1 << 15, 3, 4000, 0.5, 60.0
#: The matrix is broadcast up to this size.
MODEL_BYTES = 256 << 20


def decode_utf8(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the texts' offsets in them, without Python strings."""
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.uint32)
    first = b[at]
    out = first.copy()
    two, three, four = (first >= 0xC0) & (first < 0xE0), (first >= 0xE0) & (first < 0xF0), first >= 0xF0
    for mask, n, bits in ((two, 1, 0x1F), (three, 2, 0x0F), (four, 3, 0x07)):
        if mask.any():
            p = at[mask]
            v = b[p] & np.uint32(bits)
            for j in range(1, n + 1):
                v = (v << np.uint32(6)) | (b[p + j] & np.uint32(0x3F))
            out[mask] = v
    return out, np.searchsorted(at, offsets)


_LETTER: list[np.ndarray] = []


def letters(points: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x30000)], bool))
    return (points < 0x30000) & _LETTER[0][np.minimum(points, 0x2FFFF)]


def _fold(points: np.ndarray) -> np.ndarray:
    """Lower case for the Latin, Greek and Cyrillic blocks; every run of other characters than letters counts as spaces."""
    p = points.astype(np.uint32)
    up = ((p >= 65) & (p <= 90)) | ((p >= 0xC0) & (p <= 0xDE) & (p != 0xD7)) | ((p >= 0x391) & (p <= 0x3A9)) | ((p >= 0x410) & (p <= 0x42F))
    p = p + np.uint32(32) * up
    return np.where(letters(p), p, np.uint32(32))


def ngram_columns(points: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the hashed column of the n-gram that begins at each character."""
    p = _fold(points).astype(np.uint64)
    h = np.zeros(len(p), np.uint64)
    shift = np.uint64(64 - (buckets - 1).bit_length())
    for order in range(1, ORDERS + 1):
        n = len(p) - order + 1
        if n <= 0:
            return
        h = h[:n] * np.uint64(0x100000001B3) + p[order - 1 :] + np.uint64(1)
        yield order, ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def _whole(order: int, at: np.ndarray, n: int) -> np.ndarray:
    """The ends of each text's n-grams that do not run into the next text."""
    return np.minimum(np.maximum(at[1:] - order + 1, at[:-1]), n)


def train(labelled: DataFrame, per_language: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix [BUCKETS, languages] of log-probabilities, from (doc_id, text, lang)."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if BUCKETS * max(1, len(langs)) * 4 > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages exceed the model bound")
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, per_language / v))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003.0
    sample = labelled.filter(draw < share[F.col("lang")]).select("text", "lang")
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k (language and column in one number), n: the counts of a partition's texts, of those that occur."""
        sums = np.zeros(len(langs) * BUCKETS, np.int64)
        for b in batches:
            raw, offsets = utf8_views(b.column(0))
            of = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)
            for lo, hi in slices(offsets):
                points, at = decode_utf8(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                owner = np.repeat(of[lo:hi], np.diff(at))
                for order, col in ngram_columns(points):
                    n = len(col)
                    ok = np.arange(n) < np.repeat(_whole(order, at, n), np.diff(at))[:n]
                    sums += np.bincount((owner[:n] * BUCKETS + col)[ok], minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["k", "n"])

    # The sums are shuffled by column, so that training scans as many partitions at once as there are; BUCKETS rows a language reach the driver.
    found = sample.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(langs) * BUCKETS, np.int64)
    counts[found.column("k").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(len(langs), BUCKETS)
    p = counts + SMOOTHING
    return langs, np.ascontiguousarray(np.log(p / p.sum(axis=1, keepdims=True)).T.astype(np.float32))


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(matrix)
    names = [*langs, "und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for b in batches:
            raw, offsets = utf8_views(b.column(1))
            n_rows = len(offsets) - 1
            best, score = np.full(n_rows, len(langs)), np.zeros(n_rows)
            for lo, hi in slices(offsets) if langs else ():
                points, at = decode_utf8(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if not len(points):
                    continue
                sums = np.zeros((hi - lo, len(langs)))
                grams = np.zeros(hi - lo)
                for order, col in ngram_columns(points):
                    n = len(col)
                    stop = _whole(order, at, n)
                    start = np.minimum(at[:-1], n)
                    grams += np.maximum(stop - start, 0)
                    for k in range(len(langs)):
                        run_sum = np.concatenate(([0.0], np.cumsum(logs[:, k][col], dtype=np.float64)))
                        sums[:, k] += run_sum[np.maximum(stop, start)] - run_sum[start]
                has = np.concatenate(([0], np.cumsum(letters(points))))
                has = has[at[1:]] > has[at[:-1]]
                mean = sums / np.maximum(grams, 1)[:, None] * SHARPNESS
                e = np.exp(mean - mean.max(axis=1, keepdims=True))
                best[lo:hi] = np.where(has, mean.argmax(axis=1), len(langs))
                score[lo:hi] = np.where(has, (e / e.sum(axis=1, keepdims=True)).max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[k] for k in best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def remainder(doc_id: str, modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language. Edge cases: see :mod:`langid`."""
    docs = table(spark, sf_dir, "documents")
    labelled = docs.filter((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    out = predict(docs, *train(labelled.select("doc_id", "text", "lang")))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
