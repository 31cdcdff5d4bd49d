"""Quality by the perplexity of an n-gram language model.

The model is an interpolated modified Kneser-Ney model of characters (``ORDER`` of them) over trusted text, the documents that
``labels`` marks as good; one in ``HELD_OUT`` of those is not trained on and gives the thresholds. Code points up to the
Latin extensions are symbols of their own and all others are dealt over the remaining symbols of ``BITS`` bits, so that a
script's letters stay apart from each other and from Latin. The n-grams are 50-bit keys, whose lower orders are shifts and
masks; their tables grow with the corpus and are only ever joined.

* Documents are dealt over chunks of about ``CHUNK_BYTES`` by doc_id, packed and compressed, as text is what is shuffled.
* Sharded counts: each chunk sends its distinct n-grams once, with their counts in its training documents, to the shard of
  their hash, which merges them: one table of all n-grams, with counts. A frequent n-gram is one entry a chunk.
* Lower orders count distinct left neighbours; counts of counts give the three discounts of each order; the probabilities of
  all n-grams that any document holds follow from joins of that table with the lower orders', from order 1 up.
* Sharded answers: each shard streams its probabilities and then its chunks' n-grams, and answers each chunk. A chunk's
  documents are scored from the answers, characters in their order, over the whole text.
* Threshold: the mean log-loss of a character, shrunk towards its language's mean by ``PRIOR`` characters (short texts are
  noisy), is held against the ``QUANTILE`` of its language's held-out trusted documents. Languages with fewer than
  ``LEAST_HELD`` of those use the one over all. Fewer documents than lie one beyond the quantile can't tell it: the limit is
  then widened by its distance from the median, times the share of that one document that is missing.

Edge cases: null and empty texts have no perplexity and are not kept; without trusted text everything else is
kept, with a null threshold; without held-out trusted documents all trusted ones give the threshold; a null language is a
language of its own; a repeated doc_id is trusted or not as one and its rows are scored each; rows without a doc_id are not
trusted; ties at the threshold are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, mix64, release, row_key, slices, table, utf8_views
from .langid import decode_utf8

ORDER, BITS, LATIN = 5, 10, 0x250
#: Text of a chunk, text that a task packs at once, n-grams of a shard, and most shards.
CHUNK_BYTES, PACK_BYTES, SHARE, MOST_SHARDS = 16 << 20, 8 << 20, 1 << 19, 4096
#: Text of a chunk that is worked on at once.
SLICE = 1 << 18
HELD_OUT, QUANTILE, PRIOR, LEAST_HELD = 5, 0.99, 100.0, 20


def symbols(points: np.ndarray) -> np.ndarray:
    """1 for white space and controls, code points below LATIN themselves, 592 to 1023 for all others; 0 begins a text."""
    p = points.astype(np.uint32)
    other = LATIN + ((p * np.uint32(0x9E3779B1)) >> np.uint32(12)) % np.uint32((1 << BITS) - LATIN)
    return np.where(p <= 32, 1, np.where(p < LATIN, p, other)).astype(np.int64)


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, as a key, and the texts' offsets in characters."""
    points, at = decode_utf8(raw, offsets)
    n = np.diff(at)
    place = np.arange(len(points)) + (ORDER - 1) * (np.repeat(np.arange(len(n)), n) + 1)
    padded = np.zeros(len(points) + (ORDER - 1) * len(n), np.int64)
    padded[place] = symbols(points)
    keys = np.zeros(len(points), np.int64)
    for j in range(ORDER - 1, -1, -1):
        keys = (keys << BITS) | padded[place - j]
    return keys, at


def packed(docs: DataFrame, chunks: int, carried: list[str]) -> DataFrame:
    """chunk, ``carried`` (arrays), size (array: bytes of each text, -1: null), texts (compressed): rows of ``docs`` that go to one chunk."""
    schema = docs.schema
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks))
    rows = docs.select(F.when(F.col("doc_id").isNull(), deal(F.col("text").cast("string"))).otherwise(deal(F.col("doc_id").cast("string"))).alias("chunk"), F.col("text").cast("string").alias("text"), *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(3)
        held: list[pa.Table] = []
        waiting = 0

        def ship() -> pa.RecordBatch:
            t = pa.concat_tables(held).sort_by("chunk").combine_chunks()
            raw, offsets = utf8_views(t.column("text"))
            chunk = t.column("chunk").to_numpy()
            size = np.where(t.column("text").is_null().to_numpy(), -1, np.diff(offsets))
            cut = np.concatenate((np.flatnonzero(np.diff(chunk, prepend=-1)), [len(chunk)]))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in (*(t.column(x) for x in carried), pa.array(size))]
            texts = [zip_.compress(raw[offsets[a] : offsets[b]].tobytes()) for a, b in zip(cut, cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(chunk[cut[:-1]]), *lists, pa.array(texts, pa.binary())], ["chunk", *carried, "size", "texts"])

        for b in batches:
            for lo, hi in slices(utf8_views(b.column("text"))[1], PACK_BYTES):
                t = pa.Table.from_batches([b.slice(lo, hi - lo)])
                held.append(t)
                waiting += t.nbytes
                if waiting >= PACK_BYTES:
                    yield ship()
                    held, waiting = [], 0
        if held:
            yield ship()

    kinds = ", ".join(f"{c} array<{schema[c].dataType.simpleString()}>" for c in carried)
    return rows.mapInArrow(run, f"chunk long, {kinds}, size array<long>, texts binary")


class Chunk:
    """The rows of one chunk."""

    def __init__(self, rows: pa.Table, trusted: pa.Table, carried: list[str]):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        sizes = [len(s) for s in rows.column("size")]
        size = np.array([x for s in rows.column("size").to_pylist() for x in s], np.int64)
        texts = [unzip.decompress(t.as_py(), max_output_size=max(1, sum(max(0, x) for x in s.as_py()))) for t, s in zip(rows.column("texts"), rows.column("size"))]
        self.raw, self.offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
        del texts
        self.columns = [pc.list_flatten(rows.column(c).combine_chunks()) for c in carried]
        ids = pc.list_flatten(rows.column("doc_id").combine_chunks())
        known = trusted.filter(pc.is_valid(trusted.column("id")))
        marks = [known.filter(known.column("held") if h else pc.invert(known.column("held"))).column("id").combine_chunks() for h in (False, True)]
        self.trains, self.held = (pc.is_in(ids, m, skip_nulls=True).to_numpy(zero_copy_only=False) for m in marks)
        self.n = int(sum(sizes))

    def slices(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for lo, hi in slices(self.offsets, SLICE):
            yield lo, hi, *ngrams(self.raw[self.offsets[lo] : self.offsets[hi]], self.offsets[lo : hi + 1] - self.offsets[lo])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams and how often the training documents hold them."""
        keys, counts, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for lo, hi, k, at in self.slices():
            own, where = np.unique(k, return_inverse=True)
            keys.append(own)
            counts.append(np.bincount(where[np.repeat(self.trains[lo:hi], np.diff(at))], minlength=len(own)))
            waiting += len(own)
            if waiting > len(keys[0]) + SHARE:
                both = merged(keys, counts)
                keys, counts, waiting = [both[0]], [both[1]], 0
        return merged(keys, counts)

    def losses(self, keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters and -log P of each text, given log P of the sorted ``keys``."""
        n, loss = np.zeros(self.n, np.int64), np.zeros(self.n)
        for lo, hi, k, at in self.slices():
            if not len(k):
                continue
            where = np.minimum(np.searchsorted(keys, k), len(keys) - 1) if len(keys) else None
            if where is None or (keys[where] != k).any():
                raise RuntimeError("a chunk's documents are not those that asked")
            sums = np.concatenate(([0.0], np.cumsum(logs[where], dtype=np.float64)))
            n[lo:hi], loss[lo:hi] = np.diff(at), sums[at[:-1]] - sums[at[1:]]
        return n, loss


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and their summed counts."""
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(where, np.concatenate(counts), len(every)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, which compress when the numbers are small, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(b: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.int64)


def _keys(b: bytes) -> np.ndarray:
    return np.cumsum(_numbers(b))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * (n4 / n3 if n3 else 0)]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def with_discounts(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """k, a: each n-gram's discounted share of its context, and x, g: each context's weight for the lower order. ``t``: k, c."""
    row = t.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    d = discounts([row[f"n{i}"] for i in range(1, 5)])
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    rows = t.withColumn("x", F.shiftright("k", BITS)).withColumn("d", cut)
    totals = rows.groupBy("x").agg(F.sum("c").alias("t"), F.sum("d").alias("ds"))
    share = rows.join(totals, "x").select("k", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("t")).alias("a"))
    return share, totals.select("x", (F.col("ds") / F.col("t")).alias("g"))


def probabilities(counts: DataFrame) -> DataFrame:
    """shard, k, p: the interpolated probability of every n-gram of ``counts`` (shard, k, c: its count in training text, which may be 0)."""
    lower = lambda c, order: F.col(c).bitwiseAND((1 << BITS * (order - 1)) - 1)
    tables, needed = {ORDER: counts.filter("c > 0").select("k", "c")}, {ORDER: counts.select("shard", "k")}
    for order in range(ORDER, 1, -1):
        tables[order - 1] = materialize(tables[order].groupBy(lower("k", order).alias("k")).agg(F.count(F.lit(1)).alias("c")), "counts")
        needed[order - 1] = needed[order].select(lower("k", order).alias("k")).distinct()
    p = None
    for order in range(1, ORDER + 1):
        share, weight = with_discounts(tables[order])
        rows = needed[order].join(share, "k", "left").withColumn("x", F.shiftright("k", BITS)).join(weight, "x", "left")
        if p is None:
            rows = rows.withColumn("low", F.lit(1.0 / (1 << BITS)))
        else:
            rows = rows.withColumn("x", lower("k", order)).join(p.select(F.col("k").alias("x"), F.col("p").alias("low")), "x")
        value = F.when(F.col("g").isNull(), F.col("low")).otherwise(F.coalesce("a", F.lit(0.0)) + F.col("g") * F.col("low"))
        last, p = p, materialize(rows.select(*needed[order].columns, value.alias("p")), "probabilities")
        if last is not None:
            discard(last, tables[order - 1])
    return p


def score(docs: DataFrame, trusted: DataFrame, carried: list[str]) -> DataFrame | None:
    """``carried``, trusted, held, n_symbols, loss (-log P) of every row of ``docs``; None without training text. ``trusted``: doc_id, held."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in carried}
    ids = trusted.select(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast(kinds["doc_id"]).alias("id"), "held")
    rows = packed(docs, chunks, carried)
    number = max(1, min(MOST_SHARDS, math.ceil(size / 50 / SHARE)))  # a chunk's distinct n-grams are about a fiftieth of its characters

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["chunk", "shard", "keys", "counts"]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())], names)
        keys, counts = Chunk(left, right, carried).counts()
        shard = (mix64(keys.view(np.uint64)) % np.uint64(number)).astype(np.int64)
        own = [(i, shard == i) for i in np.unique(shard).tolist()]
        me = left.column("chunk")[0].as_py()
        return pa.Table.from_arrays([pa.array([me] * len(own), pa.int64()), pa.array([i for i, _ in own], pa.int64()), pa.array([_planes(np.diff(keys[m], prepend=0)) for _, m in own], pa.binary()), pa.array([_planes(counts[m]) for _, m in own], pa.binary())], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of a partition's shards, merged as they come."""
        last, keys, counts, n = None, [], [], 0

        def out() -> pa.RecordBatch:
            k, c = merged(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), last), pa.int64()), pa.array(k), pa.array(c)], ["shard", "k", "c"])

        for b in batches:
            for shard, k, c in zip(*(b.column(x).to_pylist() for x in ("shard", "keys", "counts"))):
                if keys and shard != last:
                    yield out()
                    keys, counts, n = [], [], 0
                last = shard
                keys.append(_keys(k))
                counts.append(_numbers(c))
                n += len(keys[-1])
                if len(keys) > 1 and n > 2 * len(keys[0]) + SHARE:
                    merged_ = merged(keys, counts)
                    keys, counts, n = [merged_[0]], [merged_[1]], len(merged_[0])
        if keys:
            yield out()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's probabilities come first, then its chunks' n-grams, which are answered at once."""
        shard, keys, logs, parts = None, np.zeros(0, np.int64), np.zeros(0, np.float32), []
        for b in batches:
            found: list[tuple] = []
            at, whose = b.column("shard").to_numpy(), b.column("chunk").is_null().to_numpy(zero_copy_only=False)
            k, p = b.column("k").to_numpy(zero_copy_only=False), b.column("p").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (whose[1:] != whose[:-1])) + 1).tolist(), len(at)]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if at[lo] != shard:
                    shard, parts, keys = at[lo], [], None
                if whose[lo]:
                    parts.append((k[lo:hi].astype(np.int64), np.log(p[lo:hi]).astype(np.float32)))
                    keys = None
                    continue
                if keys is None:
                    keys, logs = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(keys)
                    keys, logs = keys[order], logs[order]
                    parts = [(keys, logs)]
                for i in range(lo, hi):
                    asked = b.column("keys")[i].as_py()
                    found.append((b.column("chunk")[i].as_py(), asked, logs[np.searchsorted(keys, _keys(asked))].tobytes()))
            chunk, asked, values = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(asked, pa.binary()), pa.array(values, pa.binary())], ["chunk", "keys", "logs"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*carried, "trusted", "held", "n_symbols", "loss"]
        if not left.num_rows:
            kept = [pc.list_flatten(left.column(c).combine_chunks()) for c in carried]
            return pa.Table.from_arrays([*kept, *(pa.array([], t) for t in (pa.bool_(), pa.bool_(), pa.int64(), pa.float64()))], names)
        chunk = Chunk(left, right, carried)
        replies = right.filter(pc.is_valid(right.column("keys")))
        keys = np.concatenate([np.zeros(0, np.int64), *(_keys(k.as_py()) for k in replies.column("keys"))])
        logs = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(v.as_py(), np.float32) for v in replies.column("logs"))])
        order = np.argsort(keys)
        n, loss = chunk.losses(keys[order], logs[order])
        return pa.Table.from_arrays([*chunk.columns, pa.array(chunk.trains | chunk.held), pa.array(chunk.held), pa.array(n), pa.array(loss)], names)

    by = lambda t, c="chunk": t.groupBy(c)
    asked = materialize(by(rows).cogroup(by(ids)).applyInArrow(ask, "chunk long, shard long, keys binary, counts binary"), "asked")
    counts = materialize(asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard long, k long, c long"), "counts")
    if counts.filter("c > 0").isEmpty():
        return None
    none = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    found = probabilities(counts)
    discard(counts)
    release(docs.sparkSession)  # the packed texts that were shuffled for asking
    p = found.select("shard", "k", "p", *none(chunk="long", keys="binary"))
    both = p.unionByName(asked.select("shard", *none(k="long", p="double"), "chunk", "keys"))
    answers = both.repartition("shard").sortWithinPartitions("shard", F.col("chunk").asc_nulls_first()).mapInArrow(answer, "chunk long, keys binary, logs binary")
    right = ids.select("chunk", "id", "held", *none(keys="binary", logs="binary")).unionByName(answers.select("chunk", F.lit(None).cast(kinds["doc_id"]).alias("id"), *none(held="boolean"), "keys", "logs"))
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
    return by(rows).cogroup(by(right)).applyInArrow(finish, f"{schema}, trusted boolean, held boolean, n_symbols long, loss double")


def limit(loss: str) -> Column:
    """The aggregate that gives a threshold: the quantile, widened where too few documents give it."""
    q = F.percentile_approx(loss, [0.5, QUANTILE], 10_000)
    missing = F.greatest(F.lit(0.0), 1 - F.count(loss) * (1 - QUANTILE))
    return q[1] + missing * (q[1] - q[0])


def classify(docs: DataFrame, trusted: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, ``carried``, n_symbols, perplexity, shrunk_loss, threshold, trusted, held_out, keep for every row of ``docs``; ``trusted``: the doc_ids of trusted documents."""
    names = ["doc_id", "lang", *carried]
    trusted = trusted.select("doc_id").filter("doc_id is not null").distinct()
    trusted = trusted.withColumn("held", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(41)), F.lit(HELD_OUT)) == 0)
    rows = score(docs, trusted, names)
    if rows is None:
        nothing = {"shrunk_loss": F.lit(None).cast("double"), "perplexity": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double")}
        rows = docs.select(*names, F.length(F.col("text").cast("string")).cast("long").alias("n_symbols")).withColumns(nothing)
        return rows.select(*names, F.coalesce("n_symbols", F.lit(0).cast("long")).alias("n_symbols"), "perplexity", "shrunk_loss", "threshold", F.lit(False).alias("trusted"), F.lit(False).alias("held_out"), F.coalesce(F.col("n_symbols") > 0, F.lit(False)).alias("keep"))
    rows = materialize(rows, "losses")
    known = "trusted and held and n_symbols > 0"
    if rows.filter(known).isEmpty():
        known = "trusted and n_symbols > 0"

    def with_limit(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """Adds ``value`` over the known documents of a row's language, or over all where the language has few."""
        own = rows.filter(known).groupBy("lang").agg(value.alias("_own"), F.count(F.lit(1)).alias("_of")).filter(F.col("_of") >= LEAST_HELD).select(F.col("lang").alias("_lang"), "_own")
        rows = rows.crossJoin(F.broadcast(rows.filter(known).agg(value.alias("_all"))))  # one row
        return rows.join(own, rows["lang"].eqNullSafe(own["_lang"]), "left").withColumn(name, F.coalesce("_own", "_all")).drop("_lang", "_own", "_all")

    rows = with_limit(rows, F.sum("loss") / F.sum("n_symbols"), "mean")
    shrunk = F.when(F.col("n_symbols") > 0, (F.col("loss") + PRIOR * F.col("mean")) / (F.col("n_symbols") + PRIOR))
    rows = with_limit(materialize(rows.withColumn("shrunk_loss", shrunk).drop("mean"), "losses"), limit("shrunk_loss"), "threshold")
    return rows.select(
        *names, "n_symbols", F.when(F.col("n_symbols") > 0, F.exp(F.col("loss") / F.col("n_symbols"))).alias("perplexity"), "shrunk_loss", "threshold",
        "trusted", F.col("held").alias("held_out"), ((F.col("n_symbols") > 0) & F.coalesce(F.col("shrunk_loss") <= F.col("threshold"), F.lit(True))).alias("keep"),
    )


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity, its language's threshold and whether it is kept. Edge cases: see :mod:`quality`."""
    return classify(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns; a row is decided on by doc_id and text together, either of which may be null."""
    row = free_name(docs, "_row")
    rows = docs.withColumn(row, row_key())
    bad = classify(rows.select("doc_id", "lang", "text", F.col(row).alias("row")), trusted_ids(spark, sf_dir), ("row",)).filter(~F.col("keep")).select(F.col("row").alias(row)).distinct()
    return rows.join(bad.hint("merge"), row, "left_anti").select(docs.columns)
