"""Benchmark decontamination.

A document holds a benchmark item if one of its windows of the item's length in words is at least ``SIMILARITY`` like the
item by weighted 5-word shingles: sum of weights of the shared shingles over the sum of all, repeats counted, a
shingle's weight being log(1 + items / items that hold it). Words are runs without
white space, in lower case.

Candidates: SimHash fingerprints of word windows. The window's size comes from the item's: the largest power of two up
to 2/5 of its words, 16 at most. Every such window of an item is indexed, and the documents' windows are taken at a
stride of a quarter. Any passage of that similarity has so few edits that some untouched run holds a window of the
stride, which equals an indexed one; beyond that, all windows within a Hamming distance of ``RADIUS`` are found, since
fingerprints at that distance agree in one of RADIUS + 1 blocks of bits, each a table of its own. (A window as long as its
item would differ in about four bits for each word that was edited, beyond any radius that blocks of 64 bits can serve.)
Candidates that share a shingle with their item are verified exactly, at every start that leaves enough of the item for the
similarity: what is inserted or deleted before the window moves the start by at most the item's share that may be missing.

The benchmark is indexed in blocks of at most ``BLOCK_WORDS`` words, each a broadcast of a bounded size and a pass over
the documents; no text is shuffled, so copies and hot sources do not matter. Every whole text is read, in slices.

Edge cases: null and empty texts and items hold nothing and match nothing; an item of fewer than five words is one
shingle, its whole sequence; repeated documents are reported each, repeated items under each item_id; of equally like
windows the first counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import free_name, hash_words, materialize, row_key, shingle_hashes, slices, table, utf8_views

SHINGLE, SIMILARITY, RADIUS = 5, 0.75, 3
BLOCK_WORDS = 1 << 20
#: Text bytes whose windows are fingerprinted at once: their bit counts stay in the cache.
CHUNK = 1 << 18
_CHUNKS = RADIUS + 1
_WIDTH = 64 // _CHUNKS


def window_size(n_words: int) -> int:
    return min(16, 1 << max(0, int((n_words + 1) / 2.5).bit_length() - 1)) if n_words else 0


def simhash(words: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size (a power of two) the fingerprints of the windows that begin at each word; shorter by size - 1."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    out, size = {}, 1
    while True:
        if size in sizes:
            out[size] = np.packbits(bits > size // 2 if size > 1 else bits, axis=1).view("<u8").ravel()
        if size >= max(sizes) or len(bits) <= size:
            return out
        bits = bits[:-size] + bits[size:]
        size *= 2


@dataclass
class Index:
    """The items of one block and the fingerprints of their windows."""

    item_ids: list = field(default_factory=list)
    sizes: np.ndarray | None = None  # words of each item
    grams: list[dict[int, int]] = field(default_factory=list)  # each item's shingles and their numbers
    weights: dict[int, float] = field(default_factory=dict)
    default: float = 1.0
    every: np.ndarray | None = None  # all items' shingles, sorted
    #: By window size: fingerprints, items, places in them; and for each chunk of bits, a table of begins in an order.
    windows: dict[int, tuple] = field(default_factory=dict)


def build(items: list[tuple], held: dict[int, int] | None = None, whole: int | None = None) -> Index:
    """An index of (item_id, text) rows; ``held``, ``whole``: how many items of the whole benchmark hold each of their shingles, and its items, if these are a part."""
    words, at, _ = hash_words(*utf8_views(pc.utf8_lower(pa.array([t for _, t in items], pa.string()))))
    shingles, sh_at = shingle_hashes(words, at, SHINGLE)
    grams = [Counter(shingles[a:b].tolist()) for a, b in zip(sh_at, sh_at[1:])]
    held = Counter(g for c in grams for g in c) if held is None else held
    n = max(1, len(items) if whole is None else whole)
    out = Index([i for i, _ in items], np.diff(at), grams, {g: math.log(1 + n / k) for g, k in held.items()}, math.log(1 + n), np.unique(shingles))
    places: dict[int, list] = {}
    for k, size in enumerate(out.sizes):
        if c := window_size(int(size)):
            own = simhash(words[at[k] : at[k + 1]], [c])[c]
            places.setdefault(c, []).append((own, np.full(len(own), k), np.arange(len(own))))
    for c, parts in places.items():
        prints, item, place = (np.concatenate(x) for x in zip(*parts))
        tables = []
        for j in range(_CHUNKS):
            key = ((prints >> np.uint64(j * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            tables.append((np.searchsorted(key[order], np.arange((1 << _WIDTH) + 1)).astype(np.int32), order))
        out.windows[c] = (prints, item, place, tables)
    return out


def _starts(at: np.ndarray, c: int) -> np.ndarray:
    """The first words of the windows of c words of every text, at a stride of a quarter."""
    stride = max(1, c // 4)
    n = np.maximum(0, (np.diff(at) - c) // stride + 1)
    n[np.diff(at) < c] = 0
    base = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at[:-1], n) + (np.arange(len(base)) - base) * stride


def candidates(index: Index, words: np.ndarray, at: np.ndarray, shingles: np.ndarray, sh_at: np.ndarray) -> np.ndarray:
    """Distinct rows (text, item, first word in the text) whose windows are within the radius and share a shingle."""
    found = []
    sizes = sorted(index.windows)
    if not sizes or not len(words):
        return np.zeros((0, 3), np.int64)
    known = np.searchsorted(index.every, shingles)
    known = index.every[np.minimum(known, len(index.every) - 1)] == shingles
    prints = simhash(words, sizes)
    for c in sizes:
        if c not in prints:
            continue
        starts = _starts(at, c)
        fp = prints[c][starts]
        own, item, place, tables = index.windows[c]
        text = np.searchsorted(at, starts, "right") - 1
        # The shingles that touch the window; a text shorter than a shingle has one.
        first = np.clip(starts - at[text] - (1 if c < SHINGLE else 0), 0, None)
        seen = np.concatenate(([0], np.cumsum(known)))
        stop = np.minimum(sh_at[text] + np.maximum(starts - at[text] + max(1, c - SHINGLE + 1), 1), sh_at[text + 1])
        # Items of fewer words than a shingle have windows of one or two words, and share no shingle with longer texts.
        near = (seen[stop] > seen[np.minimum(sh_at[text] + first, stop)]) | (c <= 2)
        for j, (begin, order) in enumerate(tables):
            key = ((fp >> np.uint64(j * _WIDTH)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)
            lo, n = begin[key], begin[key + 1] - begin[key]
            hit = np.flatnonzero((n > 0) & near)
            if not len(hit):
                continue
            n = n[hit]
            which = np.repeat(hit, n)
            entry = order[np.repeat(lo[hit], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
            ok = np.bitwise_count(fp[which] ^ own[entry]) <= RADIUS
            which, entry = which[ok], entry[ok]
            t = text[which]
            found.append(np.stack([t, item[entry], np.maximum(starts[which] - at[t] - place[entry], 0)], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def similarity(index: Index, k: int, window: np.ndarray) -> float:
    """Weighted Jaccard similarity of an item and the shingles of a window."""
    have, both, whole = Counter(window.tolist()), 0.0, 0.0
    own = index.grams[k]
    for g in own.keys() | have.keys():
        w = index.weights.get(g, index.default)
        a, b = own.get(g, 0), have.get(g, 0)
        both, whole = both + w * min(a, b), whole + w * max(a, b)
    return both / whole if whole else 0.0


def find(index: Index, raw: np.ndarray, offsets: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int, int, float]]:
    """(text, item, first word, similarity) of the best window of every item that a text holds."""
    words, at, _ = hash_words(raw, offsets)
    shingles, sh_at = shingle_hashes(words, at, SHINGLE)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    for t, k, start in candidates(index, words, at, shingles, sh_at).tolist():
        n, have = int(index.sizes[k]), int(at[t + 1] - at[t])
        slack = max(2, math.ceil((1 - least) * n))
        for s in range(max(0, start - slack), start + slack + 1):
            if s >= have or (t, k, s) in tried:
                continue
            tried.add((t, k, s))
            if n < SHINGLE:
                window = shingle_hashes(words[at[t] + s : at[t] + min(have, s + n)], np.array([0, min(n, have - s)]), SHINGLE)[0]
            else:
                window = shingles[sh_at[t] + s : min(sh_at[t + 1], sh_at[t] + s + n - SHINGLE + 1)]
            v = similarity(index, k, window)
            if v >= least and (-v, s) < best.get((t, k), (0.0, 0)):
                best[t, k] = (-v, s)
    return [(t, k, s, -v) for (t, k), (v, s) in sorted(best.items())]


def shingles_of(items: DataFrame) -> DataFrame:
    """g: the distinct shingles of each item, repeated for each that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at, _ = hash_words(*utf8_views(pc.utf8_lower(b.column(0))))
            g, sh_at = shingle_hashes(words, at, SHINGLE)
            own = [np.unique(g[a:b]) for a, b in zip(sh_at, sh_at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["g"])

    return items.select("text").mapInArrow(run, "g long")


def frequencies(items: DataFrame) -> DataFrame:
    """g, n: how many items hold each shingle."""
    return shingles_of(items).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: each document (doc_id, text) and item (item_id, text) that it holds."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    n_words = items.agg(F.sum(F.size(F.split("text", r"[ \t-\r]+")))).first()[0] or 0
    blocks = max(1, math.ceil(n_words / BLOCK_WORDS))
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "item_id": items.schema["item_id"].dataType.simpleString()}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, start_word long, n_words long, similarity double"
    texts = docs.select("doc_id", F.col("text").cast("string"))
    out, held, whole = None, None, None
    if blocks > 1:
        held, whole = materialize(frequencies(items), "shingles"), items.count()
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    block = lambda c: F.pmod(F.xxhash64(*c), F.lit(blocks))
    for i in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.filter(block(["item_id", "text"]) == i).toLocalIterator()]
        known = None if held is None else {r["g"] & (1 << 64) - 1: r["n"] for r in held.join(shingles_of(items.filter(block(["item_id", "text"]) == i)).select("g").distinct(), "g").toLocalIterator()}
        shared = spark.sparkContext.broadcast(build(rows, known, whole))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                raw, offsets = utf8_views(pc.utf8_lower(b.column(1)))
                rows = []
                for lo, hi in slices(offsets, CHUNK):
                    rows += [(lo + t, k, s, v) for t, k, s, v in find(index, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], least)]
                t, k, s, v = zip(*rows) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(t, pa.int64())), pa.array([index.item_ids[x] for x in k], item_type), pa.array(s, pa.int64()), pa.array([int(index.sizes[x]) for x in k], pa.int64()), pa.array(v, pa.float64())],
                    ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                )

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds. Edge cases: see :mod:`decontamination`."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns; a row is decided on by doc_id and text together, either of which may be null."""
    row = free_name(docs, "_row")
    rows = docs.withColumn(row, row_key())
    held = matches(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(held.hint("merge"), row, "left_anti").select(docs.columns)
