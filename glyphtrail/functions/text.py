"""Text normalization and fuzzy alias scores.

``normalized`` and ``compacted`` are native expressions where the text is ASCII and an Arrow UDF elsewhere: Spark has no
NFKC and no case folding. Windows of a text are scored for a whole Arrow batch at once, in numpy.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that the compact form leaves out, and the version names of normalizer and matcher.
SEPARATORS = r"[\s_\-|.·:]+"
NORMALIZATION_VERSION = "nfkc-casefold-separators-v1"
MATCHER_VERSION = "window-levenshtein-v2"


def normalize_text(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def compact_text(text: str) -> str:
    return re.sub(SEPARATORS, "", normalize_text(text))


@F.pandas_udf(T.StringType())
def _normalize(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text, na_action="ignore")


def normalized(text: Column) -> Column:
    """NFKC, case folding, white space runs to one space; null stays null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    # \x1c-\x1f are white space for Unicode splitting too.
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\t-\r\x1c-\x1f ]+", " "))
    return F.when(ascii_only, plain).otherwise(_normalize(F.when(~ascii_only, text)))


def compacted(normal: Column) -> Column:
    """The compact form of a normalized text."""
    return F.regexp_replace(normal, r"(?U)[\s_\-|.·:]+", "")


def folded(text: Column) -> Column:
    """The evaluation's own form: lower case and collapsed white space, without NFKC."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def folded_compact(text: Column) -> Column:
    """The evaluation's compact form: :func:`folded` without separators."""
    return compacted(folded(text))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def similarities(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`similarity` of each pair of texts, all pairs side by side."""
    n, m = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    out = np.ones(len(a))
    unlike = np.flatnonzero([x != y for x, y in zip(a, b)])
    if not len(unlike):
        return out
    left, right = (_grid([x[i] for i in unlike]) for x in (a, b))
    n, m = n[unlike], m[unlike]
    across = np.arange(right.shape[1] + 1)
    row = np.tile(across, (len(unlike), 1))
    edits = np.where(n == 0, m, 0)
    for i in range(left.shape[1]):
        # Deletions and substitutions come from the row above; insertions spread from the left, as a running minimum.
        cell = np.concatenate((row[:, :1] + 1, np.minimum(row[:, 1:] + 1, row[:, :-1] + (right != left[:, i : i + 1]))), axis=1)
        row = np.minimum.accumulate(cell - across, axis=1) + across
        done = n == i + 1
        edits[done] = row[done, m[done]]
    out[unlike] = 1 - edits / np.maximum(n, m)
    return out


def _grid(texts: list[str]) -> np.ndarray:
    """[text, place] of code points, filled up with a number that no text has."""
    out = np.full((len(texts), max(map(len, texts))), 0xFFFFFFFF, np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def window_scores(texts: list[str], needle: str) -> np.ndarray:
    """For each text the best 1 - distance / max(n, L) over its windows of n - r to n + r characters, r = max(1, ceil(0.2 n)); 0 without a window."""
    n = len(needle)
    radius = max(1, math.ceil(0.2 * n))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    best = np.zeros(len(texts))
    if not n or not sizes.sum():
        return best
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    want = np.frombuffer(needle.encode("utf-32-le", "surrogatepass"), np.uint32)
    total, widest = len(flat), n + radius
    flat = np.concatenate((flat, np.full(widest, 0xFFFFFFFF, np.uint32)))
    room = np.repeat(ends, sizes) - np.arange(total)
    column = [np.full(total, i, np.int16) for i in range(n + 1)]
    top = np.zeros(total)
    for length in range(1, widest + 1):
        c = flat[length - 1 : length - 1 + total]
        last, column[0] = column[0], np.full(total, length, np.int16)
        for i in range(1, n + 1):
            cell = np.minimum(np.minimum(column[i], column[i - 1]) + 1, last + (c != want[i - 1]))
            last, column[i] = column[i], cell.astype(np.int16)
        if length >= max(1, n - radius):
            top = np.maximum(top, np.where(room >= length, 1 - column[n] / max(n, length), 0.0))
    some = np.flatnonzero(sizes)
    best[some] = np.maximum.reduceat(top, (ends - sizes)[some])
    return best


@F.pandas_udf(T.DoubleType())
def _scored_windows(texts: pd.Series, needles: pd.Series) -> pd.Series:
    out = pd.Series(0.0, index=texts.index)
    for needle, part in texts.groupby(needles, sort=False):
        # Slices bound the cells that are held at a time.
        parts, at, size = [], 0, 0
        rows = part.tolist()
        for i, t in enumerate(rows):
            size += len(t)
            if size > 200_000 or i == len(rows) - 1:
                parts.append(window_scores(rows[at : i + 1], needle))
                at, size = i + 1, 0
        out.loc[part.index] = np.concatenate(parts)
    return out


#: Marked so that a filter on the score is not pushed below it, where it would be computed a second time.
_windows = _scored_windows.asNondeterministic()


def pieces(needle: str, cut: float) -> list[str]:
    """Parts of a needle, one of which every window that scores at least ``cut`` holds unchanged.

    Such a window is at most (1 - cut) * longer length edits away, which leave one of that many and one more parts untouched.
    """
    n = len(needle)
    edits = math.floor((1 - cut) * (n + max(1, math.ceil(0.2 * n))) + 1e-9)
    at = [i * n // (edits + 1) for i in range(edits + 2)]
    return [needle[i:j] for i, j in zip(at, at[1:])]


def _holds_any(text: Column, parts: Column) -> Column:
    return F.exists(parts, lambda p: text.contains(p))


def alias_score(normal: Column, compact: Column, alias_normal: Column, alias_compact: Column, short_length: int = 4, parts: tuple[Column, Column] | None = None) -> Column:
    """1 for a contained alias in either form; 0 for short ones that are not; else the best window of either form.

    With ``parts``, the :func:`pieces` of both forms as arrays, texts without any of them aren't searched and score 0, which
    is exact down to the cut of the pieces.
    """
    contained = ((F.char_length(alias_normal) > 0) & normal.contains(alias_normal)) | ((F.char_length(alias_compact) > 0) & compact.contains(alias_compact))
    open_ = ~contained & (F.char_length(alias_compact) > short_length)
    forms = []
    for i, (hay, needle) in enumerate(((normal, alias_normal), (compact, alias_compact))):
        some = _holds_any(hay, parts[i]) if parts else F.lit(True)
        forms.append(_windows(F.when(open_ & some, hay).otherwise(""), needle))
    return F.when(contained, F.lit(1.0)).when(F.char_length(alias_compact) <= short_length, F.lit(0.0)).otherwise(F.greatest(*forms))


def useful(text: Column, confidence: Column, floor: float = 0.1) -> Column:
    """At least two letters or numbers of any script, and a confidence that is unknown or between ``floor`` and 1."""
    sure = confidence.isNull() | (~F.isnan(confidence) & confidence.between(floor, 1.0))
    return sure & (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) >= 2)


def timestamp_url(url: Column, seconds: Column) -> Column:
    """``url`` at a whole second; empty unless it is http or https."""
    mark = F.when(F.instr(url, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return F.when(url.rlike("^https?:"), F.concat(url, mark, F.lit("t="), F.floor(seconds).cast("string"), F.lit("s"))).otherwise("")


def html_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def format_time(seconds: Column) -> Column:
    """H:MM:SS, or MM:SS below an hour, rounded up."""
    s = F.ceil(seconds).cast("long")
    h, m, r = F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def content_id(text: Column, length: int, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("string"), 256), 1, length))
