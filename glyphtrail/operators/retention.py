"""Detections of a frame: validity, duplicate suppression and the cap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

MIN_HEIGHT, DUPLICATE_IOU, CONTAINMENT, MOST, DETECTOR_CONFIDENCE = 6.0, 0.85, 0.90, 64, 0.3


def acceptable(quad: Column, confidence: Column, width: Column, height: Column, min_height: float = MIN_HEIGHT, least: float = DETECTOR_CONFIDENCE) -> Column:
    """A convex quad inside the frame, tall enough, of a confidence between ``least`` and 1."""
    inside = F.forall(quad, lambda p: p["x"].between(0, width) & p["y"].between(0, height))
    return g.valid_quad(quad) & F.coalesce(inside & (g.dimensions(quad)[1] >= min_height) & confidence.between(least, 1.0), F.lit(False))


def suppress_frame(rows: list[tuple], iou: float = DUPLICATE_IOU, containment: float = CONTAINMENT) -> tuple[list[int], int]:
    """Indices kept of (confidence, points, identity) rows, by descending confidence, polygon, identity; and the duplicates."""
    kept: list[int] = []
    duplicates = 0
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][0], rows[i][1], rows[i][2])):
        over = (g.overlap(rows[i][1], rows[k][1]) for k in kept)
        if any(a >= iou or b >= containment for a, b in over):
            duplicates += 1
        else:
            kept.append(i)
    return kept, duplicates


def suppress(proposals: DataFrame, frame: str = "frame_id", most: int = MOST, iou: float = DUPLICATE_IOU, containment: float = CONTAINMENT) -> DataFrame:
    """One row a frame: kept identities in order (capped), duplicates, dropped. ``proposals``: frame, identity, quad, confidence; valid ones only.

    Greedy suppression needs a frame's proposals in sequence; frames are small and independent.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = [(c, [(p["x"], p["y"]) for p in q], i) for c, q, i in zip(rows["confidence"], rows["quad"], rows["identity"])]
        kept, duplicates = suppress_frame(items, iou, containment)
        names = [str(items[i][2]) for i in kept]
        return pd.DataFrame({frame: [key[0]], "kept": [names[:most]], "raw": [len(items)], "duplicates": [duplicates], "dropped": [max(0, len(names) - most)]})

    kind = proposals.schema[frame].dataType.simpleString()
    return proposals.groupBy(frame).applyInPandas(one, f"{frame} {kind}, kept array<string>, raw long, duplicates long, dropped long")


def overlapping_pairs(boxes: DataFrame, frame: str, corners: list[str]) -> DataFrame:
    """Pairs (identity, other) of a frame's axis-aligned boxes with IoU and containment, natively: a join within the frame."""
    a, b = boxes.alias("a"), boxes.alias("b")
    iou, inside = g.box_iou(tuple(F.col(f"a.{c}") for c in corners), tuple(F.col(f"b.{c}") for c in corners))
    pairs = a.join(b, (F.col(f"a.{frame}") == F.col(f"b.{frame}")) & (F.col("a.identity") < F.col("b.identity")))
    return pairs.select(F.col(f"a.{frame}").alias(frame), F.col("a.identity").alias("identity"), F.col("b.identity").alias("other"), iou.alias("iou"), inside.alias("containment"))
