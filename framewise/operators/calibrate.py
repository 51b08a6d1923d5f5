"""Calibration: value ranges, histograms, and the clipping value they suggest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators.scale import join_on


def absmax(df: DataFrame, keys: Sequence[str], col: str = "val") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.abs(F.col(col))).alias("amax"))


def histogram(
    df: DataFrame, keys: Sequence[str], col: str = "val", bins: int = 2048,
    batch: str | None = None, skip_zeros: bool = False,
) -> DataFrame:
    """Equal bins of absolute values per ``keys``: rows keys, bin, count, low, width, n_bins.

    The first batch (smallest ``batch``) fixes the range and the bin width; later
    ones append bins of that width up to their maximum, and their values below the
    first edge are not counted. Without ``batch`` all rows are one batch. Only bins
    that hold something appear; the last bin is closed.
    """
    data = df.withColumn("_v", F.abs(F.col(col)))
    if skip_zeros:
        data = data.filter(F.col("_v") != 0)
    if batch is None:
        frame = data.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("_first"))
        frame = frame.withColumn("_top", F.col("_first"))
    else:
        per = data.groupBy(*keys, batch).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        frame = per.groupBy(*keys).agg(
            F.min_by("_lo", batch).alias("low"), F.min_by("_hi", batch).alias("_first"),
            F.max("_hi").alias("_top"),
        )
    # a single-valued range is widened by a half on both sides
    flat = F.col("_first") == F.col("low")
    frame = frame.withColumns(
        {
            "low": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")),
            "_first": F.when(flat, F.col("_first") + 0.5).otherwise(F.col("_first")),
        }
    )
    frame = frame.withColumn("width", (F.col("_first") - F.col("low")) / bins)
    more = F.ceil((F.col("_top") - F.col("_first")) / F.col("width"))
    frame = frame.withColumn("n_bins", bins + F.greatest(more, F.lit(0)))
    rows = join_on(data, frame, keys).filter(F.col("_v") >= F.col("low"))
    at = F.floor((F.col("_v") - F.col("low")) / F.col("width"))
    rows = rows.withColumn("bin", F.least(at, F.col("n_bins") - 1))
    return rows.groupBy(*keys, "low", "width", "n_bins", "bin").agg(
        F.count(F.lit(1)).alias("count")
    )


WORK = 1 << 24  # steps of one task: tried values of a tensor, times what each looks at
MOST_PARTS = 256  # of one tensor; each carries the tensor's filled bins


def _parts(hist: DataFrame, keys: Sequence[str], start: int, stride: int, last: int, looks_at: int | None) -> DataFrame:
    """The filled bins of every tensor, once per part of the bins that are tried as clipping value.

    Tried are ``start``, ``start + stride`` ... below ``n_bins + last``. A part tries ``from`` up to ``to`` of
    them. Empty bins take no room, so a long range costs what it holds.
    """
    filled = hist.groupBy(*keys, "low", "width", "n_bins").agg(
        F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("_f")
    )
    tried = F.greatest(F.ceil((F.col("n_bins") + last - start) / F.lit(stride)), F.lit(0))
    each = F.size("_f") if looks_at is None else F.least(F.size("_f"), F.lit(looks_at))
    parts = F.ceil(tried * each.cast("double") / WORK)
    filled = filled.withColumn("_tried", tried).withColumn(
        "_parts", F.greatest(F.least(parts, F.lit(MOST_PARTS), F.col("_tried")), F.lit(1)).cast("long")
    )
    dealt = filled.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))

    def cut(part: Column) -> Column:
        return F.floor(part * F.col("_tried") / F.col("_parts"))

    return dealt.select(
        *keys, "_part", "low", "width", "n_bins", F.col("_f.bin").alias("bins"), F.col("_f.count").alias("counts"),
        cut(F.col("_part")).alias("from"), cut(F.col("_part") + 1).alias("to"),
    )


def _per_part(keys: Sequence[str], pick):
    """Turn ``pick(row) -> (loss, order, amax)`` into a step over batches of parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [pick(row) for row in pdf.drop(columns=list(keys)).itertuples(index=False, name=None)]
            loss, order, amax = zip(*out) if out else ((), (), ())
            yield pdf[list(keys)].assign(
                loss=np.asarray(loss, np.float64), order=np.asarray(order, np.int64), amax=np.asarray(amax, np.float64)
            )

    return run


def _mse_amax(bits: int, unsigned: bool, start: int, stride: int):
    top = 2.0 ** (bits - 1 + int(unsigned)) - 1.0
    least = 0.0 if unsigned else -top

    def pick(row) -> tuple[float, int, float]:
        _, low, width, n_bins, bins, counts, first, last = row

        def centre(i):
            return ((low + width * i) + (low + width * (i + 1))) / 2

        x, n = centre(np.asarray(bins, np.float64)), np.asarray(counts, np.float64)
        levels = np.arange(least, top + 1) if 4 * (top - least) < len(x) else None
        if levels is not None:
            # the bins shown as one level are a run: its error follows from running sums
            sums = [np.concatenate([[0.0], np.cumsum(n * x**e)]) for e in (0, 1, 2)]
        best = (float("inf"), -1, float("nan"))
        for at in range(start + first * stride, start + last * stride, stride):
            clip = centre(float(at))
            if clip == 0:
                continue
            scale = top / clip
            if levels is None or scale <= 0:
                shown = np.clip(np.rint(x * scale), least, top) / scale
                loss = float(((shown - x) ** 2 * n).sum()) / n_bins
            else:
                cuts = np.searchsorted(x, (levels[:-1] + 0.5) / scale)
                runs = [np.diff(s[np.concatenate([[0], cuts, [len(x)]])]) for s in sums]
                shown = levels / scale
                loss = float((runs[2] - 2 * shown * runs[1] + shown**2 * runs[0]).sum()) / n_bins
            if loss < best[0] or best[1] < 0:
                best = (loss, at, clip)
        return best if best[1] >= 0 else (float("inf"), 1 << 62, float("nan"))

    return pick


def _entropy_amax(bits: int, unsigned: bool, start: int, stride: int):
    levels = 1 << (bits - 1 + int(unsigned))

    def pick(row) -> tuple[float, int, float]:
        _, low, width, _, bins, counts, first, last = row
        at, n = np.asarray(bins, np.int64), np.asarray(counts, np.float64)
        # the first bin counts as the second one does
        second = n[at == 1]
        at, n = at[at > 0], n[at > 0]
        if len(second):
            at, n = np.concatenate([[0], at]), np.concatenate([second, n])
        total = n.sum()
        best, best_at = float("inf"), -1
        for stop in range(start + first * stride, start + last * stride, stride):
            m = int(np.searchsorted(at, stop))
            if m == 0:
                continue
            part = n[:m]
            level = np.minimum((at[:m] * levels) // stop, levels - 1)
            mass = np.bincount(level, weights=part, minlength=levels)
            held = np.bincount(level, minlength=levels)
            spread = mass[level] / held[level]
            beyond = total - part.sum()
            if beyond > 0 and at[m - 1] != stop - 1:
                d = float("inf")  # the clipped bins would fall where nothing is shown
            else:
                p, q = part / total, spread / spread.sum()
                p[-1] += beyond / total
                d = float((p * np.log(p / q)).sum())
            if d <= best:  # the last minimum wins
                best, best_at = d, stop
        if best_at < 0:
            return float("inf"), 1, float("nan")
        return best, -best_at, float(low + width * best_at)

    return pick


def amax(
    hist: DataFrame, keys: Sequence[str], method: str, percentile: float = 99.99, bits: int = 8,
    unsigned: bool = False, start: int = 128, stride: int = 1,
) -> DataFrame:
    """Clipping value per tensor from a histogram: ``percentile``, ``mse`` or ``entropy``.

    ``percentile``: left edge of the first bin at which the share of counted values
    reaches it. ``mse``: bin centre of least mean squared quantisation error.
    ``entropy``: edge of least divergence between the clipped and the quantised
    histogram. The last two hold the filled bins of one tensor in a task and deal its tried
    values over several; a tensor with nothing to try has NULL.
    """
    if method == "percentile":
        if not 0 <= percentile <= 100:
            raise ValueError("percentile must be in 0..100")
        return _amax_percentile(hist, keys, percentile)
    makers = {"mse": _mse_amax, "entropy": _entropy_amax}
    if method not in makers:
        raise ValueError(f"unknown method {method!r}")
    levels = 1 << (bits + int(unsigned))
    parts = _parts(hist, keys, start, stride, int(method == "entropy"), 4 * levels if method == "mse" else None)
    results = {"loss": "double", "order": "long", "amax": "double"}
    schema = parts.select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in results.items())).schema
    pick = makers[method](bits, unsigned, start, stride)
    best = parts.repartition(*keys, "_part").mapInPandas(_per_part(keys, pick), schema)
    return best.groupBy(*keys).agg(F.min_by("amax", F.struct("loss", "order")).alias("amax"))


def _amax_percentile(hist: DataFrame, keys: Sequence[str], percentile: float) -> DataFrame:
    up_to = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    share: Column = F.sum("count").over(up_to) / F.sum("count").over(whole)
    reached = hist.withColumn("_share", share).filter(F.col("_share") >= percentile / 100.0)
    edge = F.col("low") + F.col("width") * F.col("bin")
    return reached.groupBy(*keys).agg(F.min(edge).alias("amax"))
