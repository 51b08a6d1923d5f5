"""Anchor tables. Sizes are given by the caller and known before Spark starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.boxes import clip01


def _pick(values: Sequence[float], at: Column) -> Column:
    return F.get(F.array(*(F.lit(float(v)) for v in values)), at.cast("int"))


def _variances(variance: Sequence[float]) -> list[Column]:
    return [F.lit(float(v)).alias(f"var{i}") for i, v in enumerate(variance)]


def grid_anchors(
    spark: SparkSession, H: int, W: int, widths: Sequence[float], heights: Sequence[float],
    variance: Sequence[float] = (0.1, 0.1, 0.2, 0.2),
) -> DataFrame:
    """H x W x shapes boxes centred in their cells, in relative coordinates."""
    n = len(widths)
    at = F.col("anchor_id")
    shape, cell = at % n, F.floor(at / n)
    cx, cy = (cell % W + 0.5) / W, (F.floor(cell / W) + 0.5) / H
    w, h = _pick(widths, shape), _pick(heights, shape)
    return spark.range(H * W * n).withColumnRenamed("id", "anchor_id").select(
        at, (cx - w * 0.5).alias("xmin"), (cy - h * 0.5).alias("ymin"),
        (cx + w * 0.5).alias("xmax"), (cy + h * 0.5).alias("ymax"), *_variances(variance),
    )


def prior_boxes(
    spark: SparkSession, H: int, W: int, img_w: float, img_h: float, min_sizes: Sequence[float],
    max_sizes: Sequence[float] = (), aspect_ratios: Sequence[float] = (1.0,),
    step_w: float | None = None, step_h: float | None = None, offset: float = 0.5,
    clip: bool = False, variance: Sequence[float] = (0.1, 0.1, 0.2, 0.2),
) -> DataFrame:
    """Priors per cell: a square of the min size, one of sqrt(min * max), and one per ratio.

    ``aspect_ratios`` starts with 1, which stands for the squares.
    """
    shapes: list[tuple[float, float]] = []
    for i, small in enumerate(min_sizes):
        shapes.append((small, small))
        if max_sizes:
            side = (small * max_sizes[i]) ** 0.5
            shapes.append((side, side))
        for ratio in aspect_ratios[1:]:
            shapes.append((small * ratio**0.5, small / ratio**0.5))
    n = len(shapes)
    at = F.col("anchor_id")
    shape, cell = at % n, F.floor(at / n)
    cx = (cell % W + offset) * (step_w or img_w / W)
    cy = (F.floor(cell / W) + offset) * (step_h or img_h / H)
    w, h = _pick([s[0] for s in shapes], shape), _pick([s[1] for s in shapes], shape)
    sides = {
        "xmin": (cx - w / 2) / img_w, "ymin": (cy - h / 2) / img_h,
        "xmax": (cx + w / 2) / img_w, "ymax": (cy + h / 2) / img_h,
    }
    return spark.range(H * W * n).withColumnRenamed("id", "anchor_id").select(
        at, *((clip01(c) if clip else c).alias(k) for k, c in sides.items()), *_variances(variance)
    )


def base_anchors(
    spark: SparkSession, ratios: Sequence[float], scales: Sequence[float], base: int = 16
) -> DataFrame:
    """Ratio x scale anchors (cx, cy, w, h): rounded base shape times scale."""
    n = len(scales)
    at = F.col("anchor_id")
    ratio, scale = _pick(ratios, F.floor(at / n)), _pick(scales, at % n)
    # halves away from zero; sizes are positive
    w = F.floor(F.sqrt(F.lit(float(base * base)) / ratio) + 0.5)
    h = F.floor(w * ratio + 0.5)
    center = F.lit((base - 1) / 2.0)
    return spark.range(len(ratios) * n).withColumnRenamed("id", "anchor_id").select(
        at, center.alias("cx"), center.alias("cy"), (w * scale).alias("w"), (h * scale).alias("h")
    )
