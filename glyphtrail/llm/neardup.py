"""Near-duplicate groups by a multi-index Hamming join of MinHash signatures, confirmed on whole shingle sets.

1. Each text's distinct 5-word shingles give a signature of ``SLOTS`` minima. Texts of equal sets form a class; from
   here on only one row of a class is worked on, so copies cost one aggregated row.
2. Signatures are split into ``CHUNKS`` chunks of ``WIDTH`` slots. By the pigeonhole principle two that differ in at most
   ``REACH`` = 2 * CHUNKS - 1 slots have a chunk with at most one differing slot; each chunk is entered once for each slot
   left out (the allowed error), so all pairs within REACH meet under a common key. REACH is the one threshold of
   signatures: pairs beyond it aren't compared. (Two texts of a similarity of just 0.75 differ in 16 slots on average with a
   deviation of 3.5, and in more than REACH with a probability of about 2e-5.)
3. Each member of a key is paired with the key's smallest member only, and the pairs are confirmed: the sets' sizes
   must satisfy 100 * shared >= 75 * all. The links give components; most keys then hold a single one.
4. Keys that still hold several components give a spanning forest of their members whose whole signatures differ in
   at most REACH slots. What the forests connect is a block; within a block all sets of different components are
   joined exactly, in the task, by their rarest members. So no link between different texts is lost to the stars of
   step 3, and no pair is written but those that join components. Large keys and blocks are dealt in pairs of pieces.

Confirmation streams the texts of the pairs, grouped by their first text and salted by ``PER_TASK`` pairs; the text of
the corpus is shuffled once, to fetch the members' texts.

Edge cases: null and empty texts and texts of white space have no shingles and are linked with nothing; fewer than
five words are one shingle; repeated rows form a class; a repeated doc_id may be in several groups, each row in that of its
text; rows with a null doc_id are grouped like others, but a group of such rows alone has a null component; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, hash_words, materialize, mix64, row_key, shingle_hashes, slices, table, utf8_views
from .components import components, extended

SHINGLE, CHUNKS, WIDTH = 5, 16, 4
#: Slots of a signature, each in one chunk, and the most that two compared signatures differ in.
SLOTS = CHUNKS * WIDTH
REACH = 2 * CHUNKS - 1
#: Members of a key, pairs of a first text, and bytes of a block that one task reads (of the first and last, twice as many).
BLOCK, PER_TASK, BLOCK_BYTES = 4_096, 5_000, 8 << 20
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 32, SLOTS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, SLOTS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at, _ = hash_words(raw, offsets)
    hashes, at = shingle_hashes(words, at, SHINGLE)
    return [np.unique(hashes[a:b]) for a, b in zip(at, at[1:])]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """[set, SLOTS] of uint32; all sets must have members."""
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(sets), SLOTS), np.uint32)
    for j in range(SLOTS):
        h = (x ^ _B[j]) * _A[j]
        h ^= h >> np.uint32(15)
        out[:, j] = np.minimum.reduceat(h * np.uint32(0x2C1B3C6D), at)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """row (see :func:`common.row_key`), doc_id, n_shingles, set_key (null for an empty set), signature of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8_views(b.column(2))
            n, keys, signs = [], [], []
            for lo, hi in slices(offsets):
                sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                some = [s for s in sets if len(s)]
                rows = iter(minima(some)) if some else iter(())
                n += [len(s) for s in sets]
                keys += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                signs += [next(rows).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["row", "doc_id", "n_shingles", "set_key", "signature"])

    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row binary, doc_id long, n_shingles long, set_key binary, signature binary")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """key, id: each class under CHUNKS * WIDTH keys, one for each chunk and the slot of it that may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                s = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
                keys = np.empty((len(s), CHUNKS, WIDTH), np.uint64)
                for out in range(WIDTH):
                    h = np.arange(1, CHUNKS + 1, dtype=np.uint64)[None, :] * np.uint64(WIDTH) + np.uint64(out)
                    for j in range(WIDTH):
                        if j != out:
                            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
                    keys[:, :, out] = h
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), SLOTS))], ["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are similar on whole shingle sets."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).alias("salts"))
    pairs = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    heads = pairs.select("b", "salt").distinct().select(F.col("b").alias("a"), "b", "salt")
    rows = pairs.unionByName(heads).join(texts, F.col("a") == F.col("id")).select("b", "salt", "a", (F.col("a") != F.col("b")).alias("second"), "text")
    rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[tuple, np.ndarray] | None = None
        for batch in batches:
            raw, offsets = utf8_views(batch.column("text"))
            b, salt, a = (batch.column(c).to_numpy() for c in ("b", "salt", "a"))
            found = []
            for lo, hi in slices(offsets):
                for i, own in enumerate(shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), lo):
                    if a[i] == b[i]:
                        head = ((b[i], salt[i]), own)
                    elif head and head[0] == (b[i], salt[i]) and similar(own, head[1]):
                        found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[found], pa.int64()), pa.array(b[found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def candidate_forest(members: DataFrame) -> DataFrame:
    """Edges (a, b) between components that span, under each key, the graph of members whose signatures differ in at most REACH slots; ``members``: key, id, component, signature."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = _block_pairs(members.join(sizes, "key"), ["key"], ["component", "signature"])

    def spans(comps: np.ndarray, signs: np.ndarray) -> Iterator[tuple[int, int]]:
        left = np.ones(len(comps), bool)
        while left.any():
            stack = [int(np.flatnonzero(left)[0])]
            left[stack[0]] = False
            while stack:
                x = stack.pop()
                rest = np.flatnonzero(left)
                near = rest[(comps[rest] == comps[x]) | ((signs[rest] != signs[x]).sum(axis=1) <= REACH)]
                left[near] = False
                stack += near.tolist()
                yield from ((max(comps[x], c), min(comps[x], c)) for c in set(comps[near].tolist()) if c != comps[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", "i", "j"]):
            comps = t.column("component").to_numpy()
            if (comps != comps[0]).any():
                signs = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, SLOTS)
                edges = sorted(set(spans(comps, signs)))
                a, b = zip(*edges) if edges else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _block_pairs(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows (``by``, id, blocks) dealt so that any two of a group meet: every pair of the group's blocks is a group (``by``, i, j)."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*by, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", *columns)
    return rows.repartition(*by, "i", "j").sortWithinPartitions(*by, "i", "j", "id")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The whole groups of sorted batches."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        at = [*np.flatnonzero(new).tolist(), batch.num_rows]
        t, lo = pa.Table.from_batches([batch]), 0
        for k, hi in enumerate(at):
            if hi > lo:
                held.append(t.slice(lo, hi - lo))
            if k < len(at) - 1 and held:
                yield pa.concat_tables(held)
                held = []
            lo = hi
    if held:
        yield pa.concat_tables(held)


def join_sets(sets: list[np.ndarray], comps: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of similar sets that join all components that any similar pair joins.

    Exact: two similar sets share one of their rarest members, 1 + n - ceil(3n / 4) of n each, so only sets that do are compared.
    """
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(sizes)))
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(often), np.int64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rarity[token]
    index: dict[int, list[int]] = {}
    mark = np.zeros(len(often), bool)
    roots = comps.copy()
    out = []
    for x in range(len(sets)):
        own = np.sort(token[at[x] : at[x + 1]])
        n = len(own)
        prefix = own[: 1 + n - (3 * n + 3) // 4].tolist()
        seen = np.unique(np.array([y for t in prefix for y in index.get(t, ())], np.int64))
        seen = seen[(roots[seen] != roots[x]) & (100 * np.minimum(sizes[seen], n) >= 75 * np.maximum(sizes[seen], n))]
        mark[own] = True
        for lo in range(0, len(seen), 256):
            part = seen[lo : lo + 256]
            part = part[roots[part] != roots[x]]
            if not len(part):
                continue
            flat = mark[np.concatenate([token[at[y] : at[y + 1]] for y in part])]
            shared = np.add.reduceat(flat.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[part])[:-1])))
            for y in part[100 * shared >= 75 * (sizes[part] + n - shared)].tolist():
                if roots[y] != roots[x]:
                    out.append((x, y))
                    roots[roots == roots[y]] = roots[x]
        mark[own] = False
        for t in prefix:
            index.setdefault(t, []).append(x)
    return out


def settle(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between the components of each block; ``members``: block, id, component."""
    rows = members.join(texts, "id")
    sizes = rows.groupBy("block").agg(F.greatest(F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    rows = _block_pairs(rows.join(sizes, "block"), ["block"], ["component", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["block", "i", "j"]):
            raw, offsets = utf8_views(t.column("text"))
            sets = [s for lo, hi in slices(offsets) for s in shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
            ids = t.column("id").to_numpy()
            pairs = join_sets(sets, t.column("component").to_numpy().copy())
            yield pa.RecordBatch.from_arrays([pa.array([max(ids[x], ids[y]) for x, y in pairs], pa.int64()), pa.array([min(ids[x], ids[y]) for x, y in pairs], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


@dataclass
class Groups:
    #: row, doc_id, n_shingles, set_key of every row.
    rows: DataFrame
    #: set_key, id, first: the classes of equal sets, their numbers, and the doc_id and row that come first in them.
    classes: DataFrame
    #: a, b: confirmed links between classes that span every component.
    links: DataFrame
    #: node, component of every class that has a link.
    components: DataFrame


def group(docs: DataFrame) -> Groups:
    """Near-duplicate groups of ``docs`` (doc_id, text)."""
    rows = materialize(signatures(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    classes = rows.filter("set_key is not null").groupBy("set_key").agg(first, F.any_value("signature").alias("signature"))
    # Numbered as they are written: the numbers are those of the table, whatever is computed again before it is there.
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    keyed = chunk_keys(classes).repartition("key")
    pivots = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first")
    members = materialize(keyed.join(pivots, "key"), "members")
    stars = materialize(members.filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "stars")
    ids = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))).distinct()
    ids = ids.join(classes.select("id", F.col("first.row").alias("row")), "id")
    texts = docs.select(row_key().alias("row"), F.col("text").cast("string").alias("text")).join(ids.hint("merge"), "row")  # the rows grow with the corpus: shuffled at every size
    texts = materialize(texts.dropDuplicates(["row"]).select("id", "text"), "texts")
    near = materialize(near_only(stars, classes), "near")
    links = materialize(confirm(near, texts), "links")
    discard(stars, near)
    found = materialize(components(links), "components")
    placed = members.join(found, members["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    mixed = placed.join(mixed, "key").join(classes.select("id", "signature"), "id")
    forest = materialize(candidate_forest(mixed), "forest")
    discard(members)
    if not forest.isEmpty():
        blocks = components(forest).select(F.col("node").alias("component"), F.col("component").alias("block"))
        own = found.select(F.col("node").alias("id"), "component").join(blocks, "component")
        alone = blocks.join(found, "component", "left_anti").select(F.col("component").alias("id"), "component", "block")
        more = materialize(settle(own.unionByName(alone.select("component", "id", "block")).select("block", "id", "component"), texts), "links")
        links = links.unionByName(more)
        found = materialize(extended(found, more), "components")
    discard(texts)
    return Groups(rows.drop("signature"), classes.select("set_key", "id", "first"), links, found)


def near_only(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures differ in at most REACH slots."""
    signs = classes.select("id", "signature")
    rows = pairs.join(signs.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(signs.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, SLOTS) for c in ("sa", "sb"))
            keep = pa.array((x != y).sum(axis=1) <= REACH)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def assign(groups: Groups) -> DataFrame:
    """row, doc_id, n_shingles, component_id (the group's smallest doc_id), component_row (the row key that comes first in it) of every row."""
    classes = groups.classes.join(groups.components, F.col("id") == F.col("node"), "left").select("set_key", "first", F.coalesce("component", "id").alias("component"))
    least = classes.groupBy("component").agg(F.min("first").alias("least"))
    classes = classes.join(least, "component").select("set_key", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("component_row"))
    rows = groups.rows.join(classes, "set_key", "left")
    alone = F.col("set_key").isNull()
    return rows.select("row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("row")).otherwise(F.col("component_row")).alias("component_row"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether it has the group's smallest doc_id) of every row of ``docs``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return assign(group(docs)).select("doc_id", "n_shingles", "component_id", kept)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles, group and whether it stands for it. Edge cases: see :mod:`neardup`."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Parts that the copies of one row are dealt over when one of them is chosen.
SALTS = 64


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that stand for their group, one of each: that of the smallest doc_id (null last), then of the smallest row key.

    Of rows that are equal in doc_id and text one stays; rows without shingles belong to no group and stay.
    """
    row, salt = free_name(docs, "_row"), free_name(docs, "_salt")
    placed = materialize(assign(group(docs)), "placed")
    rows = docs.withColumn(row, row_key())
    gone = placed.filter("row <> component_row").select(F.col("row").alias(row)).distinct()
    rows = rows.join(gone.hint("merge"), row, "left_anti")
    repeated = materialize(placed.filter("row = component_row and n_shingles > 0").groupBy(F.col("row").alias(row)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(row), "repeated")
    if not repeated.isEmpty():
        some = rows.join(repeated.hint("merge"), row, "left_semi").withColumn(salt, (F.rand(7) * SALTS).cast("int"))
        some = some.dropDuplicates([row, salt]).dropDuplicates([row]).drop(salt)
        rows = rows.join(repeated.hint("merge"), row, "left_anti").unionByName(some)
    return rows.select(docs.columns)
