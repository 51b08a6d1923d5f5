"""Joins with dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.operators.scale import join_on


def small_enough(dim: DataFrame, max_rows: int) -> bool:
    """Whether ``dim`` has at most ``max_rows`` rows; reads no more than that."""
    return dim.limit(max_rows + 1).count() <= max_rows


def join_dim(
    df: DataFrame, dim: DataFrame, keys: Sequence[str], max_rows: int = 100_000, how: str = "left"
) -> DataFrame:
    """Join a dimension, broadcast only when its row count is checked to be small.

    A larger one takes the shuffle join, which AQE splits on skewed keys.
    """
    right = F.broadcast(dim) if small_enough(dim, max_rows) else dim
    return join_on(df, right, keys, how)


def map_label(df: DataFrame, dim: DataFrame, label: str = "label", default: int = -1) -> DataFrame:
    """Translate class ids by a table (``label``, ``mapped``); unknown ids become ``default``."""
    out = join_dim(df, dim, [label])
    return out.withColumn("mapped", F.coalesce("mapped", F.lit(default)))


def route_by_class(df: DataFrame, class2pub: DataFrame, label: str = "label") -> DataFrame:
    """Attach the output a class goes to in ``pub``; classes routed to -1 are dropped."""
    return join_dim(df, class2pub, [label]).filter(F.col("pub") >= 0)
