"""Whitening of embeddings: distributed centred covariance, leading components, broadcast projection.

Entries become whole numbers, so counts and sums are exact. The covariance is summed from centred
rows, one matrix a partition; matrices are added in Spark, and what reaches the driver has the
width of a vector. There the matrix is reduced and its leading components are found
(`symmetric_eigen`); the projection is broadcast and applied to batches of rows. A last pass
measures the covariance of the whitened rows against the identity.

Cases: rows whose vector is NULL or has a NULL or non-finite entry are left out; so are vectors
of another length than most have (of equally frequent lengths the larger counts), as they lack
entries or have too many, and those without entries; repeated rows count as often as they occur;
equal eigenvalues give any basis of their subspace, the same for all rows; directions without
variance are not components, so a single vector, or equal ones, give no rows; an empty table
gives none; an entry or deviation beyond 64-bit range is an error; a NULL key is kept; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.symmetric_eigen import leading
from framewise.session import cut_lineage, discard

COMPONENTS = 32
FACTOR, OFFSET = 64, 1_000_000
MATRIX = "i int, row array<double>"
LEAST_SHARE = 1e-12  # of the trace: an eigenvalue below it is rounding


def whole_numbers(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(``_key``, ``x``): usable vectors as whole numbers."""
    given = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = given.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    return usable.select("_key", F.transform("v", lambda c: F.floor(c * FACTOR).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and sums of the vectors, by length; as texts, as sums may pass 64 bits."""
    found: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        lengths = batch.column(0).value_lengths().to_numpy()
        for width in np.unique(lengths):
            own = _matrix(batch.column(0).filter(pa.array(lengths == width)))
            n, before = found.get(width, (0, [0] * width))
            # halves, so that a batch of large entries cannot overflow
            high, low = (own >> 32).sum(axis=0).tolist(), (own & 0xFFFFFFFF).sum(axis=0).tolist()
            found[width] = n + len(own), [b + (h << 32) + s for b, h, s in zip(before, high, low, strict=True)]
    rows = [(int(w), i, n, str(s)) for w, (n, sums) in found.items() for i, s in enumerate(sums)]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)],
        names=["width", "i", "n", "s"],
    )


def counted(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the commonest length, and their sums, exact."""
    each = rows.select("x").mapInArrow(_sums, "width int, i int, n long, s string")
    sums = each.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    most = sums.filter("i = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return 0, []
    found = sums.filter(F.col("width") == most.width).orderBy("i").collect()
    return most.n, [int(r.s) for r in found]


def _centred_sum(n: int, sums: list[int]):
    """Per partition: the sum of the outer products of centred rows, as rows of a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), len(sums)))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = centred(_matrix(batch.column(0).slice(start, 4096)), n, sums)[0]
                total += part.T @ part
        yield _as_rows(total)

    return run


def _as_rows(matrix: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * len(matrix)
    rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix)), pa.int32()), rows], names=["i", "row"])


def added(matrices: DataFrame, width: int) -> np.ndarray:
    """The sum of the partitions' matrices, row by row."""
    cells = matrices.select("i", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c"))
    out = np.zeros((width, width))
    for r in cells.collect():
        out[r.i, r.j] = r.c
    return (out + out.T) / 2


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - S/n rounded once, and the exact sum of (n x - S)^2 of each row."""
    most = max((n * abs(int(x.max(initial=0))), n * abs(int(x.min(initial=0))), *map(abs, sums)))
    if most < 1 << 62:
        far = n * x - np.array(sums, np.int64)
        widest = int(np.abs(far).max(initial=0))
        if widest**2 * max(1, x.shape[1]) < 1 << 63:
            return far / n, (far * far).sum(axis=1)
    far = x.astype(object) * n - np.array(sums, object)
    return (far / n).astype(float), np.array([int(v) for v in (far * far).sum(axis=1)], object)


def components(rows: DataFrame, n: int, sums: list[int], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, vectors as columns, trace) of the covariance of ``rows``."""
    matrix = added(rows.select("x").mapInArrow(_centred_sum(n, sums), MATRIX), len(sums)) / n
    values, found = leading(matrix, k)
    trace = float(np.trace(matrix))
    use = values > LEAST_SHARE * trace
    return values[use], found[:, use], trace


def _project(projection, n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, deviation = centred(_matrix(batch.column(1)), n, sums)
            white = part @ projection.value
            ends = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))
            # a deviation that does not fit 64 bits ends the job here
            columns = [batch.column(0), pa.array(deviation.tolist(), pa.int64()), made]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "deviation", "white"])

    return run


def _mean_and_products(width: int):
    """Per partition: number, mean and centred sum of products of the whitened rows, by Chan's update."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, total = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            own = _matrix(batch.column(0))
            if not len(own):
                continue
            m, middle = len(own), own.mean(axis=0)
            away = middle - mean
            total += (own - middle).T @ (own - middle) + np.outer(away, away) * (n * m / (n + m))
            mean, n = mean + away * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([mean.tolist()]), pa.array([total.ravel().tolist()])],
                names=["n", "mean", "products"],
            )

    return run


def identity_error(white: DataFrame, width: int) -> float:
    """Largest absolute entry of the covariance of ``white`` minus the identity.

    Parts are added entry by entry in Spark: products about the common mean are those about the
    mean of each part plus n times the outer product of the means' distance.
    """
    parts = cut_lineage(
        white.select("white").mapInArrow(_mean_and_products(width), "n long, mean array<double>, products array<double>")
    )
    at = F.posexplode("mean").alias("i", "m")
    means = parts.select("n", at).groupBy("i").agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, mean = means[0]["n"], F.array(*(F.lit(r["s"] / r["n"]) for r in means))
    away = F.zip_with("mean", mean, lambda a, b: a - b)
    outer = F.flatten(F.transform(away, lambda a: F.transform(away, lambda b: a * b)))
    whole = F.zip_with("products", outer, lambda p, o: p + o * F.col("n"))
    cells = parts.select(F.posexplode(whole).alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c"))
    worst = cells.agg(F.max(F.abs(F.col("c") / n - F.when(F.col("i") % (width + 1) == 0, 1.0).otherwise(0.0)))).first()[0]
    discard(parts)
    return float(worst)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``."""
    rows = whole_numbers(df, key, vector)
    n, sums = counted(rows)
    rows = rows.filter(F.size("x") == len(sums))
    key_type = df.schema[key].dataType.simpleString()
    values, found, trace = components(rows, n, sums, k) if n else (np.zeros(0), np.zeros((0, 0)), 0.0)
    schema = f"`{key}` {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(values):
        return df.sparkSession.createDataFrame([], schema)
    projection = df.sparkSession.sparkContext.broadcast(found / np.sqrt(values))
    # one table, so that what is measured is what is returned
    white = cut_lineage(
        rows.mapInArrow(_project(projection, n, sums), f"_key {key_type}, deviation long, white array<double>")
    )
    error = identity_error(white, len(values))
    share = F.array(*(F.lit(float(v / trace)) for v in values))
    each = white.select(F.col("_key").alias(key), "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        key, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
