"""A grid with one level per size of box.

A box lies in the cells of its own level, whose edge is at least its longer side: at most four
cells, whatever its size. A point probes one cell of every level that has boxes. Two boxes meet at
the level of the larger one: the larger is there with its own cells, the smaller is looked up in
the at most four it touches there, so small boxes are never paired in large cells. Levels in use
are as many as the sizes have binary orders of magnitude; a scalar subquery lists them.

Level 0 has the edge ``cell``; boxes smaller than that share it. Boxes with a NULL side are in no
cell; a box of infinite extent is in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import boxes as B
from framewise.functions.boxes import Box

CELL = ("_lv", "_cx", "_cy")
MEET = (*CELL, "_role")
TOP = 1100  # beyond the exponents of a double


def edge_of(level: Column, cell: float) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(2.0), level)


def padded(box: Box, pad: float | Column) -> Box:
    b = B.ordered(box)
    return Box(b.xmin - pad, b.ymin - pad, b.xmax + pad, b.ymax + pad)


def level_of(box: Box, cell: float) -> Column:
    """The smallest level whose edge is at least the longer side."""
    side = F.greatest(box.xmax - box.xmin, box.ymax - box.ymin, F.lit(float(cell)))
    return F.least(F.ceil(F.log2(side / cell)), F.lit(TOP)).cast("int")


def levels_in(df: DataFrame, box: Box, cell: float, pad: float | Column = 0.0) -> Column:
    """The levels in use, as an array; one aggregation over the box columns only."""
    return df.agg(F.collect_set(level_of(padded(box, pad), cell))).scalar()


def _whole(box: Box) -> Column:
    """No side is NULL; the order of two sides would pass over it."""
    return box.xmin.isNotNull() & box.ymin.isNotNull() & box.xmax.isNotNull() & box.ymax.isNotNull()


def _span(low: Column, high: Column, edge: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / edge), F.floor(high / edge)))


def _touched(df: DataFrame, box: Box, cell: float) -> DataFrame:
    """One row per cell of level ``_lv`` that the box touches."""
    edge = edge_of(F.col("_lv"), cell)
    return df.withColumn("_cx", _span(box.xmin, box.xmax, edge)).withColumn("_cy", _span(box.ymin, box.ymax, edge))


def own_cells(df: DataFrame, box: Box, cell: float, pad: float | Column = 0.0) -> DataFrame:
    """One row per cell of the box's own level, at most four, in ``CELL``."""
    b = padded(box, pad)
    return _touched(df.filter(_whole(box)).withColumn("_lv", level_of(b, cell)), b, cell)


def probes(df: DataFrame, u: Column, v: Column, levels: Column, cell: float) -> DataFrame:
    """One row per level in use: the cell the point lies in, in ``CELL``."""
    edge = edge_of(F.col("_lv"), cell)
    rows = df.withColumn("_levels", levels).withColumn("_lv", F.explode("_levels")).drop("_levels")
    return rows.withColumn("_cx", F.floor(u / edge)).withColumn("_cy", F.floor(v / edge))


def meeting(
    a: DataFrame, b: DataFrame, box_a: Box, box_b: Box, cell: float, pad: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``a`` and ``b`` to be joined on ``MEET``, so that boxes that touch within 2 * ``pad`` meet.

    In role 0 the box of ``a`` is the larger one or of equal level, in role 1 that of ``b``. A
    pair may meet in up to four cells; `at_home` holds in one of them.
    """
    pa, pb = padded(box_a, pad), padded(box_b, pad)
    a, b = a.filter(_whole(box_a)), b.filter(_whole(box_b))
    in_a, in_b = levels_in(a, box_a, cell, pad), levels_in(b, box_b, cell, pad)
    return climbing(a, pa, in_b, cell), climbing(b, pb, in_a, cell, own_role=1)


def climbing(df: DataFrame, box: Box, levels: Column, cell: float, own_role: int = 0) -> DataFrame:
    """One row per cell of the own level, in ``own_role``, and of the levels of ``levels`` above it,
    in the other role: `MEET`. Boxes of one level meet in role 0 only."""
    own = level_of(box, cell)

    def at(level: Column, role: int) -> Column:
        return F.struct(level.alias("l"), F.lit(role).alias("r"))

    above = F.filter("_levels", lambda x: x > own if own_role == 0 else x >= own)
    places = F.concat(F.array(at(own, own_role)), F.transform(above, lambda x: at(x, 1 - own_role)))
    rows = df.withColumn("_levels", levels).withColumn("_at", F.explode(places)).drop("_levels")
    rows = rows.withColumn("_lv", F.col("_at.l")).withColumn("_role", F.col("_at.r")).drop("_at")
    return _touched(rows, box, cell)


def at_home(low_a: tuple[Column, Column], low_b: tuple[Column, Column], cell: float) -> Column:
    """True in the one cell that holds the lower corner of the intersection.

    ``low_a`` and ``low_b`` are the lower corners as given to `meeting`, padded alike.
    """
    edge = edge_of(F.col("_lv"), cell)
    return (F.floor(F.greatest(low_a[0], low_b[0]) / edge) == F.col("_cx")) & (
        F.floor(F.greatest(low_a[1], low_b[1]) / edge) == F.col("_cy")
    )
