"""Detection chains put together from operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions import boxes as B
from framewise.functions.boxes import Box, Quad
from framewise.operators.aggregate import keep_topk, topk
from framewise.operators.filters import drop_label, score_filter
from framewise.operators.suppress import nms


def decode(rows: DataFrame, code: str, clip: bool = False, use_variance: bool = True) -> DataFrame:
    """Offsets ``o0..o3`` against the prior box and variances of their row."""
    loc = Quad(*(F.col(f"o{i}") for i in range(4)))
    var = Quad(*(F.col(f"var{i}") for i in range(4))) if use_variance else None
    box = B.decode_boxes(loc, Box.of(), var, code, clip)
    return rows.select("frame", "det_id", "label", "score", *box.columns())


def detect(
    det: DataFrame, score_threshold: float, nms_iou: float, keep: int, top_k: int = 400,
    background: int | None = None, strict: bool = False, frame: Sequence[str] = ("frame",),
    share_classes: bool = False, pad: bool = False, iou: str = "plain",
) -> DataFrame:
    """Score and class filter, best ``top_k`` per class, NMS, best ``keep`` per frame.

    Suppression runs per frame and class, or over all classes with ``share_classes``.
    The top-k bounds what a class can bring into the suppression of a frame.
    """
    order = ["-score", "det_id"]
    rows = score_filter(det, score_threshold, strict)
    if background is not None:
        rows = drop_label(rows, background)
    rows = topk(rows, [*frame, "label"], order, top_k)
    group = list(frame) if share_classes else [*frame, "label"]
    # a class brings at most top_k boxes, so its group needs no size check
    bounded = None if share_classes or top_k > 2048 else top_k
    kept = nms(rows, group, nms_iou, iou=iou, known_size=bounded)
    return keep_topk(kept, list(frame), order, keep, pad)


def propose(
    rows: DataFrame, frame: Sequence[str], before: int, nms_iou: float, keep: int, iou: str = "plain"
) -> DataFrame:
    """Proposals by foreground score: best ``before``, NMS, best ``keep``; NULL scores never count."""
    order = ["-score", "det_id"]
    alive = topk(rows.filter(F.col("score").isNotNull()), list(frame), order, before)
    kept = nms(alive, list(frame), nms_iou, iou=iou, known_size=before if before <= 2048 else None)
    return topk(kept, list(frame), order, keep, rank="slot")


def propose_levels(
    levels: dict[int, DataFrame], frame: Sequence[str], before: int, nms_iou: float, per_level: int,
    keep: int, iou: str = "plain",
) -> DataFrame:
    """Proposals of each level, then the best over all levels."""
    parts = [
        propose(df, frame, before, nms_iou, per_level, iou).drop("slot").withColumn("level", F.lit(n))
        for n, df in levels.items()
    ]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    return topk(together, list(frame), ["-score", "det_id"], keep, rank="slot")
