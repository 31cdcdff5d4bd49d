"""Document fingerprints by a randomised edit embedding.

Embedding: a walk shared by all texts reads the text from left to right. At step j it writes down the current
character and then, by a random bit that depends only on j and the character, stays or moves on. Two texts that
differ by few edits get back in step after a short while, so few written characters differ: the edit distance
becomes a Hamming distance. The walk starts anew every ``BLOCK`` characters, so that all blocks of many texts are
walked side by side in numpy, and an edit disturbs its own block and shifts the others by its length only.

Bit sampling: bit t of the fingerprint looks at one step and keeps one hashed bit of the character written there.
The step is drawn by priority: every unit of ``UNIT`` steps has a random priority for t, and the unit of the least
priority among those that the text has is taken. Texts of nearly equal lengths thus sample the same steps, and the
share of equal bits estimates the Hamming distance. Likeness is 2 * share - 1, at least 0: unrelated texts agree in
half of their bits.

:func:`near_pairs`, which no registered query calls, bands the fingerprints so that two near ones differ in at most two bits of
some band, compares all members of a band in pairs of bounded blocks, and verifies on the whole fingerprints: no pair is lost.

Edge cases: a null text is empty; an empty text's fingerprint is all zeros, and its likeness to any non-empty text
is 0; rows that repeat a doc_id are ordered by their text; with a single row the next document is the row itself;
an empty table gives an empty result. Memory is bounded by an Arrow batch, and a hot source plays no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table

BITS, BLOCK, UNIT, SEED = 256, 1024, 16, 7
#: Steps of a block's walk: each character takes two on average.
STEPS = 2 * BLOCK
#: Blocks that are walked side by side.
WIDTH = 2048
#: Members of a band value that meet in one group of a join.
MEMBERS = 2000
#: Text of a range of documents that one task walks.
PART_BYTES = 64 << 20


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (STEPS, 256), dtype=np.int32)


@lru_cache(maxsize=64)
def _samples(units_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bit, the units at which the least priority so far changes, up to 2^units_log2 units, in one ascending key (bit, unit)."""
    n = 1 << units_log2
    bits, units = [], []
    for t in range(BITS):
        priority = mix64(np.arange(n, dtype=np.uint64) * np.uint64(BITS) + np.uint64(t + 1 + (SEED << 40)))
        least = np.minimum.accumulate(priority)
        at = np.flatnonzero(np.concatenate(([True], least[1:] < least[:-1])))
        bits.append(np.full(len(at), t, np.int64))
        units.append(at)
    bit, unit = np.concatenate(bits), np.concatenate(units)
    return (bit << 40) | unit, unit


def _sampled_steps(n_chars: np.ndarray) -> np.ndarray:
    """[text, bit]: the step, counted over the whole text at two a character, that the bit looks at."""
    units = np.maximum(1, -(-2 * n_chars // UNIT))
    key, unit = _samples(max(12, int(units.max() - 1).bit_length()))
    bit = np.arange(BITS, dtype=np.int64)
    at = np.searchsorted(key, (bit[None, :] << 40) | (units[:, None] - 1), "right") - 1
    u = unit[at]
    inside = (mix64(u.astype(np.uint64) * np.uint64(BITS) + bit.astype(np.uint64)[None, :] + np.uint64(1 << 50)) % np.uint64(UNIT)).astype(np.int64)
    return np.minimum(u * UNIT + inside, np.maximum(2 * n_chars[:, None] - 1, 0))


def embed(texts: list[np.ndarray]) -> np.ndarray:
    """Fingerprints [text, BITS / 8] of texts given as arrays of code points."""
    n_chars = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    if not len(texts) or not n_chars.any():
        return out
    start = np.concatenate(([0], np.cumsum(n_chars)))
    flat = np.concatenate([*texts, np.zeros(1, np.uint32)]).astype(np.uint32)
    folded = (flat ^ (flat >> np.uint32(8)) ^ (flat >> np.uint32(16))).astype(np.uint8)
    blocks = -(-n_chars // BLOCK)
    block_at = np.concatenate(([0], np.cumsum(blocks)))
    owner = np.repeat(np.arange(len(texts)), blocks)
    begin = start[owner] + (np.arange(block_at[-1]) - block_at[owner]) * BLOCK
    end = np.minimum(begin + BLOCK, start[owner + 1])
    # The sampled steps, sorted by block.
    step = _sampled_steps(n_chars)
    some = np.flatnonzero(n_chars > 0)
    text_of = np.repeat(some, BITS)
    step = step[some].ravel()
    block = block_at[text_of] + step // STEPS
    step %= STEPS
    order = np.argsort(block, kind="stable")
    sorted_block = block[order]
    written = np.empty(len(order), np.uint32)
    moves = _moves()
    long_first = np.argsort(begin - end, kind="stable")  # blocks of like lengths are walked together
    lo_of, hi_of = np.searchsorted(sorted_block, np.arange(block_at[-1])), np.searchsorted(sorted_block, np.arange(block_at[-1]), "right")
    for w in range(0, len(long_first), WIDTH):
        which = long_first[w : w + WIDTH]
        steps = int(2 * (end[which] - begin[which]).max())
        last = end[which]
        pos = begin[which].copy()
        path = np.empty((steps, len(which)), np.int64)
        for j in range(steps):
            path[j] = pos
            pos += moves[j][folded.take(pos)]
            np.minimum(pos, last, out=pos)
        sizes = hi_of[which] - lo_of[which]
        column = np.repeat(np.arange(len(which)), sizes)
        ask = order[np.repeat(lo_of[which], sizes) + np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        at = path[step[ask], column]
        written[ask] = np.where(at < last[column], flat[np.minimum(at, len(flat) - 1)] + np.uint32(1), np.uint32(0))
    bit = np.tile(np.arange(BITS, dtype=np.uint64), len(some))
    bits = (mix64((written.astype(np.uint64) << np.uint64(16)) + bit + np.uint64(SEED)) & np.uint64(1)).astype(np.uint8)
    out[some] = np.packbits(bits.reshape(len(some), BITS), axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of fingerprints and their texts' lengths; an empty text is like an empty one only."""
    equal = 1 - np.unpackbits(a ^ b, axis=1).mean(axis=1)
    return np.where((n_a == 0) | (n_b == 0), (n_a == n_b).astype(float), np.maximum(0, 2 * equal - 1))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, _part, _guest: rows dealt into ranges of doc_id, sorted; each range ends with guests, the first of the next range.

    One shuffle of the text. The cuts are ``parts`` - 1 doc_ids (0: as many as keep a range below PART_BYTES); the rows at a cut, and
    the first document of all for the last range, are sent to two ranges. A row finds its range in two steps of about the root of the
    number of cuts.
    """
    doc_id, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    least = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = parts or max(least, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART_BYTES))
    q = rows.agg(F.min("doc_id").alias("first"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("cuts") if parts > 1 else F.array().alias("cuts")).first()
    first, cuts = q["first"], sorted(set(q["cuts"] or []) - {q["first"]})
    # A cut is a doc_id that exists; the rows from it on are a range.
    part, at_cut = F.lit(0), F.lit(False)
    if cuts:
        step = math.isqrt(len(cuts)) + 1
        groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
        below = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
        literals = lambda values: F.array(*[F.lit(c) for c in values])
        group = F.greatest(below(literals([g[0] for g in groups])), F.lit(1))
        part = (group - 1) * step + below(F.element_at(F.array(*[literals(g) for g in groups]), group))
        at_cut = (part > 0) & (F.element_at(literals(cuts), F.greatest(part, F.lit(1))) == F.col("doc_id"))
    has_null = F.col("doc_id").isNull()
    rows = rows.withColumn("_part", F.when(has_null, F.lit(0)).otherwise(part).cast("int"))
    to = F.when(F.coalesce(at_cut, F.lit(False)), F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("g")), F.struct((F.col("_part") - 1).alias("p"), F.lit(1).alias("g"))))
    nulls = first is not None and bool(rows.filter(has_null).limit(1).count())
    is_first = has_null if nulls or first is None else F.col("doc_id") == F.lit(first)
    own = F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("g")))
    rows = rows.withColumn("_to", F.explode(F.concat(F.coalesce(to, own), F.when(is_first, F.array(F.struct(F.lit(len(cuts)).alias("p"), F.lit(2).alias("g")))).otherwise(F.array().cast("array<struct<p:int,g:int>>")))))
    rows = rows.select("doc_id", "text", F.col("_to.p").alias("_part"), F.col("_to.g").alias("_guest"))
    return rows.repartition(len(cuts) + 1, "_part").sortWithinPartitions("_part", "_guest", F.col("doc_id").asc_nulls_first(), "text")


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text, whose last quarter is the next document's beginning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            ids, texts, parts_, guests = (b.column(i).to_pylist() for i in range(4))
            size = 0
            # The held row waits for its follower; a chunk is bounded by its characters.
            chunk = [held] if held else []
            for row in zip(ids, texts, parts_, guests):
                chunk.append(row)
                size += len(row[1])
                if size >= 3 << 20:
                    yield from emit(chunk)
                    chunk, size = [chunk[-1]], 0
            if len(chunk) > 1:
                yield from emit(chunk)
            held = chunk[-1] if chunk else held

    def emit(chunk: list[tuple]) -> Iterator[pa.RecordBatch]:
        """One result for each row but the last that has a follower in its range; guests only follow."""
        own = [(i, chunk[i], chunk[i + 1]) for i in range(len(chunk) - 1) if not chunk[i][3] and chunk[i + 1][2] == chunk[i][2]]
        if not own:
            return
        points = [code_points(r[1]) for r in chunk]
        prints = embed(points)
        edited, shas = [], []
        for i, row, follower in own:
            q = len(points[i]) // 4
            mixed = np.concatenate((points[i][: len(points[i]) - q], points[i + 1][:q]))
            edited.append(mixed)
            shas.append(hashlib.sha256((row[1][: len(row[1]) - q] + follower[1][:q]).encode("utf-8", "surrogatepass")).hexdigest())
        edits = embed(edited)
        at = np.array([i for i, _, _ in own])
        n = np.array([len(p) for p in points])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for _, r, _ in own], pa.int64()),
                pa.array(n[at], pa.int64()),
                pa.array(shas),
                pa.array([prints[i].tobytes().hex() for i in at]),
                pa.array([e.tobytes().hex() for e in edits]),
                pa.array(likeness(prints[at], edits, n[at], np.array([len(e) for e in edited]))),
                pa.array(likeness(prints[at], prints[at + 1], n[at], n[at + 1])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, parts or 0).mapInArrow(run, schema)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every text of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 3 << 20):
                    size += len(texts[hi] or "")
                    hi += 1
                points = [code_points(t) for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(p) for p in points], pa.int64()), pa.array([e.tobytes().hex() for e in embed(points)])], ["doc_id", "n_chars", "fingerprint"])
                lo = hi

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def near_pairs(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """Links (first, doc_id, likeness) of a likeness of at least ``least``, from the fingerprints of :func:`fingerprint`.

    Equal fingerprints are one class, named by its smallest doc_id, to which its members are linked; between classes
    every near pair is written. Near fingerprints differ in at most ``errors`` bits, so in at most two of some band; a class is
    entered under its own value of each band and under all values that differ in one bit, where such two meet.
    """
    errors = int(BITS * (1 - least) / 2 + 1e-9)
    bands = max(errors // 3 + 1, 6)
    edges = np.arange(bands + 1) * BITS // bands

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                raw = np.frombuffer(bytes.fromhex("".join(b.column(1).to_pylist())), np.uint8).reshape(-1, BITS // 8)
                bits, words, ids = np.unpackbits(raw, axis=1).astype(np.int64), raw.view(np.int64), b.column(0).to_numpy()
                for i in range(bands):
                    flips = 1 << np.arange(edges[i + 1] - edges[i], dtype=np.int64)
                    v = ((bits[:, edges[i] : edges[i + 1]] @ flips)[:, None] ^ np.append(flips, 0)).ravel()
                    row = np.repeat(np.arange(len(ids)), len(flips) + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(ids[row]), *(pa.array(words[row, k]) for k in range(4))], ["band", "v", "id", "w0", "w1", "w2", "w3"])

    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    rows = classes.select("doc_id", "fingerprint").mapInArrow(enter, "band int, v long, id long, w0 long, w1 long, w2 long, w3 long")
    sizes = rows.groupBy("band", "v").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    rows = rows.join(sizes.filter("blocks > 1"), ["band", "v"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda n, i, j: rows.select("band", "v", F.col(i).alias("i"), F.col(j).alias("j"), *[F.col(c).alias(f"{n}_{c}") for c in ("id", "w0", "w1", "w2", "w3")])
    apart = sum((F.bit_count(F.col(f"a_w{k}").bitwiseXOR(F.col(f"b_w{k}"))) for k in range(1, 4)), F.bit_count(F.col("a_w0").bitwiseXOR(F.col("b_w0"))))
    pairs = side("a", "own", "other").join(side("b", "other", "own"), ["band", "v", "i", "j"]).filter((F.col("a_id") < F.col("b_id")) & (apart <= errors))
    pairs = pairs.select(F.col("a_id").alias("first"), F.col("b_id").alias("doc_id"), (1 - 2 * apart / BITS).alias("likeness")).distinct()
    members = prints.join(classes.select("fingerprint", F.col("doc_id").alias("first")), "fingerprint").filter("first < doc_id").select("first", "doc_id", F.lit(1.0).alias("likeness"))
    return pairs.unionByName(members)


def op10_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness. Edge cases: see :mod:`fingerprints`."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
