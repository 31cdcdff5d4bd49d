"""Seams for detectors and recognizers: plain callables over lists, run over Arrow batches with their answers checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTIONS = "frame_id string, identity string, quad array<struct<x:double,y:double>>, confidence double"
#: What a detector gives for a frame: identity, four points, confidence.
Detection = tuple[str, list[tuple[float, float]], float]
Detector = Callable[[Sequence[Any]], Sequence[Sequence[Detection]]]
Recognizer = Callable[[Sequence[Any]], Sequence[tuple[str, float | None]]]


def checked(frames: Sequence[Any], results: Sequence[Sequence[Detection]]) -> Sequence[Sequence[Detection]]:
    """One result for each frame, of identities that are unique in it."""
    if len(results) != len(frames):
        raise RuntimeError(f"{len(frames)} frames were given, {len(results)} results came back")
    for found in results:
        if len({d[0] for d in found}) != len(found):
            raise RuntimeError("a frame's detections share an identity")
    return results


def detected(frames: DataFrame, detector: Detector, batch: int = 1) -> DataFrame:
    """frame_id, identity, quad, confidence of every detection in ``frames`` (frame_id, content), which go to the detector ``batch`` at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[tuple] = []
            for lo in range(0, len(part), batch):
                some = part.iloc[lo : lo + batch]
                given = some["content"].tolist()
                for frame, found in zip(some["frame_id"], checked(given, detector(given))):
                    out += [(frame, str(i), [{"x": float(x), "y": float(y)} for x, y in points], float(c)) for i, points, c in found]
            yield pd.DataFrame(out, columns=["frame_id", "identity", "quad", "confidence"])

    return frames.select(F.col("frame_id").cast("string"), "content").mapInPandas(run, DETECTIONS)


def scripted(results: dict[Any, Sequence[Detection]]) -> Detector:
    """A detector that looks its answers up by the frame's content; frames that it doesn't know have none."""
    return lambda frames: [list(results.get(f, ())) for f in frames]


def recognized(crops: DataFrame, recognizer: Recognizer, batch: int = 32) -> DataFrame:
    """``crops`` (content and others) with raw_text and ocr_confidence.

    Crops of several frames share a batch: rows are taken as they come, and the answers are put beside them by position.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in crops.schema if f.name != "content") + ", raw_text string, ocr_confidence double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts: list[tuple[str, float | None]] = []
            for lo in range(0, len(part), batch):
                given = part["content"].iloc[lo : lo + batch].tolist()
                answers = recognizer(given)
                if len(answers) != len(given):
                    raise RuntimeError(f"{len(given)} crops were given, {len(answers)} texts came back")
                texts += answers
            yield part.drop(columns="content").assign(raw_text=[t for t, _ in texts], ocr_confidence=[c for _, c in texts])

    return crops.mapInPandas(run, schema)


def frame_accounting(proposals: DataFrame, suppressed: DataFrame, kept: DataFrame, useful) -> DataFrame:
    """frame_id, raw, duplicates, dropped, recognized, accepted: what became of each frame's proposals.

    ``proposals``: all of them by frame_id; ``suppressed``: frame_id, duplicates, dropped; ``kept``: the recognised ones by frame_id,
    which ``useful`` (a condition) accepts or not.
    """
    raw = proposals.groupBy("frame_id").agg(F.count(F.lit(1)).alias("raw"))
    read = kept.groupBy("frame_id").agg(F.count(F.lit(1)).alias("recognized"), F.count_if(useful).alias("accepted"))
    rows = raw.join(suppressed.select("frame_id", "duplicates", "dropped"), "frame_id", "left").join(read, "frame_id", "left")
    return rows.na.fill(0, ["duplicates", "dropped", "recognized", "accepted"])
