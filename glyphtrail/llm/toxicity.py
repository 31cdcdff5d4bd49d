"""Toxicity by compression distance.

Two zstandard dictionaries of equal size, an ordinary and a toxic one, share a base that zstandard trains on windows of
ordinary text and on those pieces of it that resemble the toxic terms; the toxic one ends in the terms, the ordinary one in
blanks. So a window differs only where it holds a whole term, not where a word shares some letters with one. (A
dictionary that zstandard trains on toxic windows learns their ordinary language and tells nothing.)

Terms come from the toxic texts by contrast. Byte n-grams inside a word with its spaces (``GRAMS``) contrast if they occur in
``LIFT`` times as many toxic texts as the ordinary ones let expect, with a z score of ``LEAST_Z``. Every toxic word then
votes for its strongest gram only, and grams that keep too few votes leave, so a root is found once for all its
endings; a term is a gram with the letters that mostly stand around it. Each gram is judged alone, so a small language's are
found beside a large one's. An occurrence counts once per text and only in a context of three words not met before, and
of texts that look like copies one is learnt from, so copies make no contrast.

A text is cut into windows of about ``WINDOW`` bytes at spaces; a window's distance is its compressed length with the
ordinary dictionary less that with the toxic one. Mean, maximum, shares and numbers of the windows beyond some distances go
through a logistic function; the result is the score, 0.7 the threshold. Its weights are calibrated on the labelled
sample in two halves, each measured with dictionaries of the other.

The sample is bounded: about ``TRAIN_TOXIC`` and ``TRAIN_ORDINARY`` labelled texts of at most ``TRAIN_BYTES`` bytes each, drawn by a
hash of doc_id. The driver counts grams in a slice of it at a time, in tables of fixed size. Scoring reads every whole text.

Edge cases: null and empty texts get the score of a text without distances; where one label is missing in the
sample, or nothing contrasts, every score is the share of toxic labels, below the threshold; a doc_id with both labels
is not learnt from; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _ODD, hash_words, mix64, shingle_hashes, slices, table
from .langid import remainder

WINDOW, BASE, LIKE, TERM_BYTES, THRESHOLD = 48, 8000, 4000, 2000, 0.7
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_BYTES = 2000, 4000, 8192
#: Bytes of a gram; the least texts and share of the toxic texts, z score and lift of one that contrasts.
GRAMS, LEAST_DOCS, LEAST_SHARE, LEAST_Z, LIFT = (5, 6, 7, 8), 6, 0.01, 6.0, 3.0
#: Sizes of the tables of grams and of contexts; rounds of votes; the share of a gram's occurrences that a term's letter stands in.
TABLE_BITS, CONTEXT_BITS, ROUNDS, MOSTLY = 20, 25, 3, 0.6
#: Shingle minima by which copies are told, samples that zstandard trains on, and sample bytes that are counted at once.
MINIMA, SAMPLES, SLICE = 6, 40_000, 1 << 20
_STEPS = (1, 2, 3, 5)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    prior: float


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    b = _padded(text or "")
    out, i, n = [], 0, len(b) - 1
    while i < n:
        j = b.find(b" ", i + size)
        j = n if j < 0 else j
        out.append(b[i : j + 1])
        i = j
    return out


@lru_cache(maxsize=8)
def _compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(window_log=14, hash_log=14, chain_log=14, search_log=5, min_match=6, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def distances(text: str | None, model: Model) -> np.ndarray:
    a, b = _compressor(model.ordinary).compress, _compressor(model.toxic).compress
    return np.array([len(a(w)) - len(b(w)) for w in windows(text)] or [0], np.int32)


def features(d: np.ndarray) -> list[float]:
    """A constant, the number of windows, and what speaks for toxic text: mean, maximum and sum of distances, shares and numbers beyond some."""
    n, beyond = len(d), [np.count_nonzero(d >= s) for s in _STEPS]
    whole = float(d[d >= 2].sum())
    return [1.0, np.log1p(n) / 4, float(np.clip(d, -3, 8).mean()), min(int(d.max()), 16) / 8, np.log1p(whole) / 4, whole / n, *(4 * k / n for k in beyond), *(np.log1p(k) / 4 for k in beyond)]


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression; what speaks for toxic text never has a negative one."""
    use = np.ones(x.shape[1], bool)
    while True:
        w, own = np.zeros(int(use.sum())), x[:, use]
        ridge = np.diag([1e-3] + [0.05] * (len(w) - 1))
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + ridge, own.T @ (y - p) - ridge @ w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        out = np.zeros(x.shape[1])
        out[use] = w
        if (out[2:] >= 0).all():
            return out
        use[2 + int(np.argmin(out[2:]))] = False


def _padded(text: str) -> bytes:
    return b" " + " ".join(text.lower().split()).encode("utf-8", "replace") + b" "


Sample = list[tuple[str, int]]


def distinct(sample: Sample) -> Sample:
    """The sample without texts that share a shingle minimum with an earlier one of their label: those of half as many shingles alike mostly do."""
    met: set[tuple] = set()
    out = []
    for text, y in sample:
        raw = _padded(text)
        words, at, _ = hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        shingles, _ = shingle_hashes(words, at)
        least = [(y, j, int(mix64(shingles + np.uint64(7919 * j + 1)).min())) for j in range(MINIMA if len(shingles) else 0)]
        if least and not any(x in met for x in least):
            met.update(least)
            out.append((text, y))
    return out


def _texts(sample: Sample) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of the sample: its rows from and to, their padded texts' bytes and offsets."""
    raws = [_padded(t) for t, _ in sample]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    for lo, hi in slices(offsets, SLICE):
        yield lo, hi, np.frombuffer(b"".join(raws[lo:hi]), np.uint8), offsets[lo : hi + 1] - offsets[lo]


def grams(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and table places of the ``size``-byte strings that lie in one word and its two spaces."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x100000001B3) + raw[j : j + n] + np.uint64(1)
    spaces = np.concatenate(([0], np.cumsum(raw == 32)))
    inner = spaces[size - 1 : size - 1 + n] - spaces[1 : n + 1]  # those between the first and last byte
    text = np.searchsorted(offsets, np.arange(n), "right")
    at = np.flatnonzero((inner == 0) & (np.arange(n) + size <= offsets[text]))
    return at, (mix64(h[at]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _occurrences(sample: Sample) -> Iterator[tuple]:
    """For each slice its bytes, and for each gram in a context of three words not met before: begin, size, place, word, text."""
    met = np.zeros(1 << CONTEXT_BITS, bool)
    for lo, hi, raw, offsets in _texts(sample):
        words, at, starts = hash_words(raw, offsets)
        if not len(words):
            continue
        own = np.repeat(np.arange(lo, hi), np.diff(at))
        around = np.concatenate((words[:1], words, words[-1:]))
        context = (mix64(mix64(around[:-2] * _ODD + words) * _ODD + around[2:]) >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)
        fresh = np.zeros(len(words), bool)
        fresh[np.unique(context, return_index=True)[1]] = True
        fresh &= ~met[context]
        met[context] = True
        for size in GRAMS:
            begin, place = grams(raw, offsets, size)
            word = np.maximum(np.searchsorted(starts, begin + 1, "right") - 1, 0)  # a gram may begin with the space before its word
            use = fresh[word]
            yield lo, raw, begin[use], size, place[use], word[use], own[word[use]]


def _held(pairs: np.ndarray) -> np.ndarray:
    """[place]: how many texts hold it, from text and place as one number, repeats allowed."""
    return np.bincount(np.unique(pairs) & ((1 << TABLE_BITS) - 1), minlength=1 << TABLE_BITS)


def contrasts(sample: Sample) -> np.ndarray:
    """[place]: whether the grams of a place of the table set the toxic texts of the sample apart."""
    held = np.zeros((2, 1 << TABLE_BITS), np.int64)
    y = np.array([t for _, t in sample], np.int64)
    for _, _, _, _, place, _, text in _occurrences(sample):
        for label in (0, 1):
            mine = y[text] == label
            held[label] += _held(text[mine] << TABLE_BITS | place[mine])
    expect = (held[0] + 0.5) * max(1, y.sum()) / max(1, (1 - y).sum())
    least = max(LEAST_DOCS, LEAST_SHARE * y.sum())

    def strength(docs: np.ndarray) -> np.ndarray:
        z = (docs - expect) / np.sqrt(expect)
        return np.where((docs >= np.maximum(least, LIFT * expect)) & (z >= LEAST_Z), z, 0.0)

    z, toxic = strength(held[1]), [(t, 1) for t, bad in sample if bad]
    for _ in range(ROUNDS):
        votes, groups = np.zeros(1 << TABLE_BITS, np.int64), {}
        for lo, _, _, size, place, word, text in _occurrences(toxic):
            some = z[place] > 0
            groups.setdefault(lo, []).append((place[some], word[some], text[some], np.full(int(some.sum()), size)))
            if size != GRAMS[-1]:
                continue
            place, word, text, sizes = (np.concatenate(x) for x in zip(*groups.pop(lo)))
            order = np.lexsort((-sizes, -z[place], word))
            first = order[np.diff(word[order], prepend=-1) != 0]
            votes += _held(text[first] << TABLE_BITS | place[first])
        z = np.where(z > 0, strength(votes), 0.0)
    return z > 0


def toxic_terms(sample: Sample, hot: np.ndarray) -> list[bytes]:
    """The contrasting grams of the toxic texts, each with the letters that mostly stand around it, the most frequent last."""
    around: dict[bytes, list[tuple[bytes, bytes]]] = {}
    for _, raw, begin, size, place, _, _ in _occurrences([(t, y) for t, y in sample if y]):
        for x in begin[hot[place]].tolist():
            around.setdefault(raw[x : x + size].tobytes(), []).append((raw[max(0, x - 24) : x].tobytes()[::-1], raw[x + size : x + size + 24].tobytes()))

    def mostly(strings: list[bytes]) -> bytes:
        out, n = b"", len(strings)
        while strings and not out.endswith(b" "):
            letters = Counter(s[len(out)] for s in strings if len(s) > len(out))
            if not letters:
                break
            letter, times = min(letters.items(), key=lambda x: (-x[1], x[0]))
            if times < MOSTLY * n:
                break
            strings = [s for s in strings if len(s) > len(out) and s[len(out)] == letter]
            out += bytes([letter])
        return out

    terms: dict[bytes, int] = {}
    for gram, sides in around.items():
        left = b"" if gram.startswith(b" ") else mostly([a for a, _ in sides])[::-1]
        right = b"" if gram.endswith(b" ") else mostly([b for _, b in sides])
        terms[left + gram + right] = max(len(sides), terms.get(left + gram + right, 0))
    kept: list[bytes] = []
    for term in sorted(terms, key=lambda t: (-terms[t], t)):
        if terms[term] >= LEAST_DOCS and not any(term in k or k in term for k in kept) and sum(map(len, kept)) + len(term) <= TERM_BYTES:
            kept.append(term)
    return kept[::-1]


def like_terms(sample: Sample, terms: list[bytes]) -> list[bytes]:
    """Pieces of the ordinary texts that share four bytes with a term and don't hold its first six."""
    shared = np.unique([int.from_bytes(t[i : i + 4], "little") for t in terms for i in range(len(t) - 3)])
    begins = [t.strip()[:6] for t in terms]
    out = []
    for _, _, raw, _ in _texts([(t, y) for t, y in sample if not y]):
        if len(raw) < 8:
            continue
        r = raw.astype(np.uint32)
        at = np.flatnonzero(np.isin(r[:-3] | r[1:-2] << 8 | r[2:-1] << 16 | r[3:] << 24, shared))
        first, last = at[np.diff(at, prepend=-9) > 2], at[np.diff(at, append=len(raw) + 9) > 2]
        for a, b in zip(np.maximum(first - 2, 0).tolist(), (last + 6).tolist()):
            piece = raw[a:b].tobytes()
            if not any(t in piece for t in begins):
                out.append(piece)
    return out[:: max(1, len(out) // SAMPLES)]


def trained(samples: list[bytes], size: int) -> bytes:
    """``size`` bytes of dictionary content that zstandard trains; of too few or too small samples, the samples themselves."""
    import zstandard

    try:
        content = zstandard.train_dictionary(size + 256, samples).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(dict.fromkeys(samples))
    return content[-size:].rjust(size, b" ")


def dictionaries(sample: Sample) -> tuple[bytes, bytes] | None:
    """The contents of the ordinary and the toxic dictionary; None where nothing contrasts."""
    terms = toxic_terms(sample, contrasts(sample))
    if not terms:
        return None
    every = max(1, sum(len(t) for t, bad in sample if not bad) // WINDOW // SAMPLES)
    pool = [w for i, w in enumerate(w for t, bad in sample if not bad for w in windows(t)) if i % every == 0]
    base, own = trained(like_terms(sample, terms), LIKE) + trained(pool, BASE), b"".join(terms)
    return base + b" " * (len(own) + 16), base + own + b" " * 16  # zstandard doesn't look for matches in the last bytes


def fit(sample: Sample) -> Model:
    """Dictionaries and calibration from (text, 0 or 1) rows; the rows' order plays no part."""
    sample = distinct(sorted(sample))
    y = np.array([bool(t) for _, t in sample], bool)
    prior = float(y.mean()) if len(y) else 0.0
    found = dictionaries(sample) if y.any() and not y.all() else None
    if not found:
        return Model(b"", b"", (), min(prior, THRESHOLD / 2))
    model = Model(*found, (), prior)
    half = np.array([zlib.crc32(t.encode("utf-8", "replace")) % 2 for t, _ in sample])
    x = np.empty((len(sample), len(features(np.zeros(1, np.int32)))))
    for h in (0, 1):
        other = dictionaries([s for s, k in zip(sample, half) if k != h])
        of = Model(*other, (), prior) if other else model
        for i in np.flatnonzero(half == h):
            x[i] = features(distances(sample[i][0], of))
    w = calibrated(x, y)
    return Model(model.ordinary, model.toxic, tuple(float(v) for v in w), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of ``docs`` (doc_id, text)."""

    def one(text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(features(distances(text, model)), model.weights), -30, 30)))) if model.weights else model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def draw_sample(docs: DataFrame, labels: DataFrame, column: str) -> list[tuple[str, int]]:
    """(text, label) rows: a bounded draw of both labels, by a hash of doc_id."""
    labels = labels.groupBy("doc_id").agg(F.min(F.col(column).cast("int")).alias("y"), F.max(F.col(column).cast("int")).alias("other"))
    labels = labels.filter("doc_id is not null and y = other and y in (0, 1)").select("doc_id", "y")
    sizes = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {0: TRAIN_ORDINARY, 1: TRAIN_TOXIC}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_003)) / 1_000_003.0
    share = F.when(F.col("y") == 1, min(1.0, most[1] / sizes.get(1, 1))).otherwise(min(1.0, most[0] / sizes.get(0, 1)))
    chosen = labels.filter(draw < share)
    # One narrow row a doc_id, about TRAIN_TOXIC + TRAIN_ORDINARY of them whatever the table holds; were it not so, they would be shuffled.
    few = chosen.count() <= 2 * (TRAIN_TOXIC + TRAIN_ORDINARY)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES))
    return [(r["text"], r["y"]) for r in texts.join(F.broadcast(chosen) if few else chosen.hint("merge"), "doc_id").select("text", "y").toLocalIterator()]


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that are not held out. Edge cases: see :mod:`toxicity`."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(draw_sample(docs, labels.filter(remainder("doc_id", 3) != 1), "toxic"))
    return score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
