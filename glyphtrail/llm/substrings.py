"""Exact substring removal: every byte covered by a ``LENGTH``-byte string that also starts anywhere else.

The suffixes that can matter are sorted in buckets, one bucket at a time:

1. Every window of LENGTH bytes has an anchor, its first least-hashed ``GRAM``-byte string; equal windows have equal
   anchors at equal offsets. An anchor covers a run of windows, about 85. Anchors that occur once in the corpus
   can't hold a repeated window; counting the anchors (one narrow row each) finds the others. Nothing is lost.
2. Documents with a repeated anchor send, for each, the bytes of its windows (a fragment) to the anchor's bucket.
   Fragments that are equal within a task are settled there: each place is a span, merged by document, and the bucket
   gets one copy without places. An anchor that occurs more than ``HOT`` times is spread over buckets by the content of
   its windows, so that no bucket gathers an unbounded group.
3. A task reads its buckets in order, ``BLOCK`` bytes at a time: it sorts the window suffixes of that block by bucket,
   offset from the anchor and a key of their LENGTH bytes. Ties are resolved exactly by difference-cover ranks: the
   positions whose residues modulo ``PERIOD`` lie in ``COVER`` (so that any two positions have a common shift onto the
   sample) are ranked beforehand by their first 5 * PERIOD bytes, in rounds that double the depth; two suffixes are equal if
   their first and last bytes and the ranks at their common shift are. Memory is bounded by the block.
4. Repeated windows become spans, merged per document; the texts of documents without any are not read again.

All comparisons are on bytes; the hashes only decide what is compared.

Edge cases: null texts are empty; texts shorter than LENGTH keep everything; overlapping repeats count; repeated rows
(equal doc_id and text) are different documents that repeat each other; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, free_name, materialize, mix64, slices, table, utf8_views

LENGTH, GRAM = 200, 32
#: Rows whose 64-bit hash is another's too: at 10^11 rows about 270 are to be expected.
MOST_SHARED = 10_000
REACH = LENGTH - GRAM + 1
HOT = 20_000
BLOCK = 1 << 21
#: Bytes of distinct fragments and their places among which a task looks for equal ones before the shuffle, and spans that wait to be merged by document.
SCOPE, WAITING = 8 << 20, 1 << 18
#: The offset of rows that hold spans in place of a fragment.
SETTLED = -1
_PLACE = struct.Struct("=qq")
#: A perfect difference set: every residue modulo PERIOD is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_SHIFT = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])


def rolling(raw: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes that begin at each position."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix64((sums[length:] - sums[:-length]) * down[:n])


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's anchors: text, position, fingerprint, and the first and last window that it stands for."""
    none = np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    texts = np.flatnonzero(lengths >= LENGTH)
    if not len(texts):
        return none, none, none.astype(np.uint64), none, none
    grams = rolling(raw, GRAM)
    n = len(grams)
    # Least hash and first position in one number; equal truncated hashes go by position, alike in equal windows.
    bits = np.uint64(max(24, int(n).bit_length()))
    key = ((grams >> bits) << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // REACH)
    grid = np.full(blocks * REACH, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = key
    grid = grid.reshape(blocks, REACH)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - REACH + 1
    least = np.minimum(behind[:windows], ahead[REACH - 1 : REACH - 1 + windows])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = lengths[texts] - LENGTH + 1
    owner = np.repeat(texts, sizes)
    start = np.repeat(offsets[texts] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))
    at = at[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return owner[new], at[new], grams[at[new]], start[new], start[last]


def _ragged(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenated ranges lo[i] ... lo[i] + size[i] - 1."""
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _class(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples."""
    rank = columns[0]
    for k, c in enumerate(columns):
        order = np.lexsort((c, rank)) if k else np.argsort(c, kind="stable")
        a, b = rank[order], c[order]
        new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = np.empty(len(c), np.int64)
        rank[order] = new
    return rank


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """The rank of each cover position of the text by its first 5 * PERIOD bytes, at its place; -1 elsewhere."""
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    last = words[np.minimum(sample + 24, len(words) - 1)] >> np.uint64(8)  # the 7 bytes that complete a period
    one = np.full(n + 5 * PERIOD, -1, np.int64)
    one[sample] = _class(words[sample], words[sample + 8], words[sample + 16], last)
    two = np.full(n + 5 * PERIOD, -1, np.int64)
    two[sample] = _class(one[sample], one[sample + PERIOD])
    four = np.full(n + 5 * PERIOD, -1, np.int64)
    four[sample] = _class(two[sample], two[sample + 2 * PERIOD])
    five = np.full(n, -1, np.int64)
    five[sample] = _class(four[sample], one[sample + 4 * PERIOD])
    return five


def repeated_windows(text: np.ndarray, bucket: np.ndarray, offset: np.ndarray, at: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Which window suffixes of a block have an equal in their bucket.

    ``text`` is the fragments' bytes; window i begins at ``at[i]``, belongs to ``bucket[i]`` with ``offset[i]`` to its anchor, and
    occurs ``copies[i]`` times as it stands.
    """
    n = len(text)
    out = copies > 1
    key = rolling(text, LENGTH)[at]
    order = np.lexsort((key, offset, bucket))
    b, o, k = bucket[order], offset[order], key[order]
    tied = (b[1:] == b[:-1]) & (o[1:] == o[:-1]) & (k[1:] == k[:-1])
    if not tied.any():
        return out
    head = np.concatenate(([True], ~tied))
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    check = np.flatnonzero(~head)
    x, y = at[order[check]], at[first[check]]
    padded = np.concatenate((text, np.zeros(6 * PERIOD + 8, np.uint8))).astype(np.uint64)
    words = np.zeros(n + 5 * PERIOD, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + len(words)]
    ranks = cover_ranks(words, n)
    equal = np.ones(len(x), bool)
    for d in (0, 8, 16, 24, LENGTH - 48, LENGTH - 40, LENGTH - 32, LENGTH - 24, LENGTH - 16, LENGTH - 8):
        equal &= words[x + d] == words[y + d]
    shift = _SHIFT[x % PERIOD, y % PERIOD]
    equal &= ranks[x + shift] == ranks[y + shift]
    out[order[check[equal]]] = True
    out[first[check[equal]]] = True
    for i in check[~equal]:  # equal keys of unequal windows: compare with every other of the tie
        run = order[(b == b[i]) & (o == o[i]) & (k == k[i])]
        own = text[at[order[i]] : at[order[i]] + LENGTH].tobytes()
        same = [j for j in run if text[at[j] : at[j] + LENGTH].tobytes() == own]
        if len(same) > 1:
            out[same] = True
    return out


def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = utf8_views(b.column(1))
        rid = b.column(0).to_numpy()
        for lo, hi in slices(offsets, BLOCK // 4):
            owner, _, prints, _, _ = anchors(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            order = np.lexsort((prints, owner))
            o, p = owner[order], prints[order]
            new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (p[1:] != p[:-1])))) if len(o) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate((new, [len(o)])))
            yield pa.RecordBatch.from_arrays([pa.array(p[new].view(np.int64)), pa.array(rid[lo:hi][o[new]]), pa.array(n.astype(np.int32))], ["print", "rid", "n"])


def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, offset, fragment, places, copies: each distinct fragment of a scope of about SCOPE bytes of them, with the (rid, first byte)
    where it occurs if that is one place; and, with the offset SETTLED, by document the spans of those that occur in several."""
    rows: dict[tuple[int, int, bytes], list[int]] = {}
    held = 0
    for b in batches:
        raw, offsets = utf8_views(b.column("text"))
        rid = b.column("rid").to_numpy()
        live, hot = (c.to_pylist() for c in (b.column("live"), b.column("hot")))
        for lo, hi in slices(offsets, BLOCK // 4):
            base = offsets[lo]
            own = raw[base : offsets[hi]]
            owner, at, prints, first, last = anchors(own, offsets[lo : hi + 1] - base)
            prints = prints.view(np.int64)
            cut = np.searchsorted(owner, np.arange(hi - lo + 1))
            keep, spread = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
            for i in range(hi - lo):
                part = slice(cut[i], cut[i + 1])
                keep[part] = np.isin(prints[part], live[lo + i])
                if hot[lo + i]:
                    spread[part] = np.isin(prints[part], hot[lo + i])
            owner, at, prints, first, last, spread = (x[keep] for x in (owner, at, prints, first, last, spread))
            if spread.any():  # one fragment a window, in a bucket of its content
                size = np.where(spread, last - first + 1, 1)
                start = _ragged(first, size)
                owner, at, prints, last, spread = (np.repeat(x, size) for x in (owner, at, prints, last, spread))
                last = np.where(spread, start, last)
                first = start
                content = rolling(own, LENGTH)[first].view(np.int64)
                prints = np.where(spread, prints ^ content, prints)
            data, begin = own.tobytes(), offsets[lo:hi] - base
            for p, o, s, e, t in zip(prints.tolist(), (at - first).tolist(), first.tolist(), last.tolist(), owner.tolist()):
                places = rows.get(key := (p, o, data[s : e + LENGTH]))
                if places is None:
                    places = rows[key] = []
                    held += len(key[2])
                places += (int(rid[lo + t]), s - int(begin[t]))
                held += 16
            if held >= SCOPE:
                yield from _ship(rows)
                rows, held = {}, 0
    yield from _ship(rows)


def _ship(rows: dict[tuple[int, int, bytes], list[int]]) -> Iterator[pa.RecordBatch]:
    """A scope's fragments, and the spans of those that occur twice in it: they are settled, and their bucket needs one copy without places."""
    places, copies, known = [], [], []
    for (_, _, fragment), at in rows.items():
        copies.append(min(2, len(at) // 2))
        if len(at) > 2:
            known.append(np.array(at, np.int64).reshape(-1, 2)[:, [0, 1, 1]] + (0, 0, len(fragment)))
        places.append(np.array(at if len(at) == 2 else (), np.int64).tobytes())
    buckets, offset, fragment = (list(c) for c in (zip(*rows) if rows else ([], [], [])))
    for rid, spans in _by_document(known):
        buckets.append(rid)  # any bucket will do: these go by document
        offset.append(SETTLED)
        fragment.append(b"")
        places.append(spans)
        copies.append(0)
    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(offset, pa.int32()), pa.array(fragment, pa.binary()), pa.array(places, pa.binary()), pa.array(copies, pa.int32())], ["bucket", "offset", "fragment", "places", "copies"])


def _by_document(parts: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(rid, its merged spans as bytes) of arrays of (rid, lo, hi)."""
    rows = np.concatenate(parts) if parts else ()
    if len(rows):
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cut = [0, *(np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1).tolist(), len(rows)]
        for lo, hi in zip(cut, cut[1:]):
            yield int(rows[lo, 0]), merge_spans(rows[lo:hi, 1:]).tobytes()


def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, spans: covered bytes (lo, hi) of a document; batches come sorted by bucket.

    Of a fragment that occurs twice every window is repeated, so its places become spans as they come; only those of
    fragments seen once are held. A bucket therefore holds its distinct fragments, whatever the number of places.
    """
    own: dict[tuple[int, bytes], list] = {}  # of the bucket: copies, and the place of the only one
    held: list[tuple[int, int, bytes, int, bytes]] = []  # of earlier buckets: the same, with the bucket and the offset
    places: list[int] = []  # rid, lo, hi one after another
    settled: list[tuple[int, bytes]] = []
    size = waiting = 0
    bucket = None

    def close() -> int:
        """Hold the bucket if it has fragments seen once and others that they may share windows with; the bytes held."""
        if len(own) < 2 or all(c > 1 for c, _ in own.values()):
            return 0
        held.extend((bucket, o, f, c, p) for (o, f), (c, p) in own.items())
        return sum(len(f) for _, f in own)

    def flush() -> None:
        if not held:
            return
        buckets, offset, fragment, copies, place = zip(*held)
        buckets, offset, copies = np.array(buckets, np.int64), np.array(offset, np.int64), np.array(copies, np.int64)
        lengths = np.array([len(f) for f in fragment], np.int64)
        text = np.frombuffer(b"".join(fragment), np.uint8)
        begin = np.cumsum(lengths) - lengths
        n = lengths - LENGTH + 1
        at = _ragged(begin, n)
        of = np.repeat(np.arange(len(held)), n)
        found = repeated_windows(text, buckets[of], offset[of] - (at - begin[of]), at, copies[of])
        hit = np.flatnonzero(found & (copies[of] == 1))
        if not len(hit):
            return
        new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])))
        heads = np.flatnonzero(new)
        tails = np.concatenate((heads[1:], [len(hit)])) - 1
        run_of = of[hit[heads]]
        lo, hi = at[hit[heads]] - begin[run_of], at[hit[tails]] - begin[run_of] + LENGTH
        only = np.frombuffer(b"".join(p or bytes(16) for p in place), np.int64).reshape(-1, 2)[run_of]
        places.extend(np.stack([only[:, 0], only[:, 1] + lo, only[:, 1] + hi], axis=1).ravel().tolist())

    def out() -> pa.RecordBatch:
        parts = [np.array(places, np.int64).reshape(-1, 3)]
        if settled:
            rid, spans = zip(*settled)
            parts.append(np.column_stack([np.repeat(np.array(rid, np.int64), [len(s) // 16 for s in spans]), np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)]))
        rows = list(_by_document(parts))
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], ["rid", "spans"])

    for batch in batches:
        for b, o, f, p, c in zip(*(column.to_pylist() for column in batch.columns)):
            if o == SETTLED:
                settled.append((b, p))
                waiting += len(p) // 16
            else:
                if b != bucket:
                    size += close()
                    own = {}
                    if size >= BLOCK:
                        flush()
                        held, size = [], 0
                    bucket = b
                before = own.get((o, f))
                if before is None:
                    own[o, f] = [c, p]
                else:
                    for place in (before[1], p):
                        if place:
                            rid, start = _PLACE.unpack(place)
                            places += (rid, start, start + len(f))
                            waiting += 1
                    before[:] = 2, b""
            if waiting >= WAITING:
                yield out()
                places, settled, waiting = [], [], 0
    close()
    flush()
    if places or settled:
        yield out()


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of a union of spans [lo, hi)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack([spans[new, 0], reach[np.concatenate((new[1:], [len(spans)])) - 1]], axis=1)


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, n_removed, n_spans, kept: what is left of each text without its spans, as bytes."""
    for b in batches:
        raw, offsets = utf8_views(b.column("text"))
        found = b.column("spans").to_pylist()
        removed, n_spans, kept = [], [], []
        for i in range(b.num_rows):
            own = raw[offsets[i] : offsets[i + 1]]
            spans = merge_spans(np.frombuffer(b"".join(found[i]), np.int64).reshape(-1, 2))
            left = np.ones(len(own), bool)
            for x, y in spans.tolist():
                left[x:y] = False
            n_spans.append(len(spans))
            removed.append(int((~left).sum()))
            kept.append(own[left].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["rid", "n_removed", "n_spans", "kept"])


def row_ids(docs: DataFrame) -> Column:
    """A 64-bit id of doc_id and text that is equal for repeated rows only.

    It is a hash; the few rows whose hash is another row's too, found by a count over narrow rows, get one of another seed.
    """
    plain, other = F.xxhash64("doc_id", "text"), []
    while True:
        id_ = plain
        for seed, shared in enumerate(other, 1):
            id_ = F.when(id_.isin(shared), F.xxhash64(F.lit(seed), "doc_id", "text")).otherwise(id_)
        rows = docs.select(id_.alias("id"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")).alias("md5"))
        clash = rows.groupBy("id").agg(F.min("md5").alias("a"), F.max("md5").alias("b")).filter("a <> b").select("id")
        shared = [r["id"] for r in clash.limit(MOST_SHARED + 1).collect()]
        if not shared:
            return id_
        if len(shared) > MOST_SHARED:
            raise RuntimeError(f"more than {MOST_SHARED} rows share a 64-bit hash")
        other.append(shared)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with rid: equal for repeated rows only."""
    return docs.withColumn("rid", row_ids(docs))


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (rid, text) of ``docs`` that may lose bytes, and rid, spans of those that do; one row a rid."""
    texts = docs.select("rid", F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(count_anchors, "print long, rid long, n int").repartition("print")
    often = rows.groupBy("print").agg(F.sum("n").alias("times")).filter("times > 1")
    live = rows.join(often, "print").groupBy("rid").agg(F.collect_set("print").alias("live"), F.collect_set(F.when(F.col("times") > HOT, F.col("print"))).alias("hot"))
    found = materialize(texts.join(live, "rid"), "repeats")
    parts = found.mapInArrow(fragments, "bucket long, offset int, fragment binary, places binary, copies int")
    spans = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort_buckets, "rid long, spans binary")
    return found, spans.groupBy("rid").agg(F.collect_list("spans").alias("spans"))


def cuts(docs: DataFrame) -> DataFrame:
    """rid, n_removed, n_spans, kept (binary) of the texts of ``docs`` (rid, text) that lose bytes; one row a rid."""
    found, spans = repeats(docs)
    return found.select("rid", "text").dropDuplicates(["rid"]).join(spans, "rid").select("rid", "text", "spans").mapInArrow(cut_texts, "rid long, n_removed long, n_spans long, kept binary")


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps. Edge cases: see :mod:`substrings`."""
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    changed = cuts(docs).select("rid", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    rows = docs.select("doc_id", "rid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    rows = rows.join(changed, "rid", "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


def _cut(text: str | None, spans: list[bytes] | None) -> str | None:
    if text is None or spans is None:
        return text
    raw, at, left = text.encode(), 0, []
    for lo, hi in merge_spans(np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)).tolist():
        left.append(raw[at:lo])
        at = hi
    return b"".join([*left, raw[at:]]).decode("utf-8", "ignore")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the repeated bytes cut from their texts; what remains of a character cut in two is dropped.

    n_chars, where there is one, counts the new text.
    """
    rid, found, text = (free_name(docs, c) for c in ("_rid", "_spans", "_text"))
    rows = docs.withColumn(rid, row_ids(docs.select("doc_id", F.col("text").cast("string").alias("text"))))
    # The spans alone go to the documents: no text is shuffled but with its row.
    _, spans = repeats(rows.select(F.col(rid).alias("rid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    cut = F.udf(_cut, "string", useArrow=True)
    out = rows.join(spans.select(F.col("rid").alias(rid), F.col("spans").alias(found)), rid, "left")
    out = out.withColumn(text, F.when(F.col(found).isNotNull(), cut(F.col("text").cast("string"), found)).otherwise(F.col("text")))
    columns = [F.col(text).alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)
