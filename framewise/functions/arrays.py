"""Functions on arrays of scores, and on tensors' values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def softmax(arr: Column, scale: float = 1.0) -> Column:
    """exp(scale * (x - max)) over its sum."""
    def share(weights: Column) -> Column:
        return let(array_sum(weights), lambda s: F.transform(weights, lambda w: w / s))

    return let(
        F.array_max(arr),
        lambda top: let(F.transform(arr, lambda x: F.exp((x - top) * scale)), share),
    )


def group_softmax(arr: Column, sizes: Sequence[int], scale: float = 1.0) -> Column:
    """Softmax inside consecutive groups of the given sizes."""
    parts, start = [], 1
    for size in sizes:
        parts.append(softmax(F.slice(arr, start, size), scale))
        start += size
    return F.concat(*parts)


def argmax(arr: Column) -> Column:
    """Zero-based index of the first maximum."""
    return F.array_position(arr, F.array_max(arr)) - 1


def max_score(arr: Column) -> Column:
    return F.array_max(arr)


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def fuse_prob(a: Column, b: Column) -> Column:
    """Normalised product of two distributions, computed in logarithms."""
    return softmax(F.zip_with(a, b, lambda x, y: F.log(x) + F.log(y)))


def one_vs_rest(label: Column, w: Column, n: int) -> Column:
    """``w`` on one class, the rest spread evenly over the other n - 1."""
    rest = (1.0 - w) / (n - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == label, w).otherwise(rest)
    )


def fuse_heatmaps(h: Column, f: Column, a: float = 0.056256, m: float = 0.876241) -> Column:
    """Detector map ``h`` blended with feedback map ``f``: additive and product part."""
    base = 1.0 - a - m
    return F.zip_with(h, f, lambda x, y: x + y * (a / base) + x * y * (m / base))


def l2_normalize(arr: Column, eps: float = 1e-10, scale: float = 1.0) -> Column:
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x) + eps)
    return let(norm, lambda n: F.transform(arr, lambda x: x / n * scale))


def rescale(arr: Column, a: float = 2.0 / 255.0, b: float = -1.0) -> Column:
    return F.transform(arr, lambda x: x * a + b)


def channel_major(arr: Column, channels: int, reverse: bool = False) -> Column:
    """Interleaved channels to one block per channel, optionally in reversed order."""
    def channel(c: int) -> Column:
        return F.filter(arr, lambda x, i: i % channels == c)

    order = range(channels - 1, -1, -1) if reverse else range(channels)
    return F.concat(*(channel(c) for c in order))


def to_byte(c: Column, lo: float = 27315.0, hi: float = 33315.0) -> Column:
    """Affine map of lo..hi to 0..255, halves to even, saturating."""
    return F.greatest(F.least(F.rint((c - lo) * (255.0 / (hi - lo))), F.lit(255.0)), F.lit(0.0))


def _bounds(bits: int, unsigned: bool, narrow: bool) -> tuple[float, float]:
    top = 2.0 ** (bits - 1 + int(unsigned)) - 1.0
    return (0.0 if unsigned else (-top if narrow else -top - 1.0)), top


# Fixed value: an amax up to this counts as zero.
TINY_AMAX = 1.0 / (1 << 24)


def quantize(
    c: Column, amax: Column, bits: int = 8, unsigned: bool = False, narrow: bool = True
) -> Column:
    """Symmetric integer code of ``c``; all codes are 0 where amax is about 0."""
    low, top = _bounds(bits, unsigned, narrow)
    code = F.greatest(F.least(F.rint(c * (F.lit(top) / amax)), F.lit(top)), F.lit(low))
    return F.when(amax <= TINY_AMAX, F.lit(0.0)).otherwise(code)


def fake_quantize(
    c: Column, amax: Column, bits: int = 8, unsigned: bool = False, narrow: bool = True
) -> Column:
    """Quantise and scale back."""
    _, top = _bounds(bits, unsigned, narrow)
    step = F.when(amax <= TINY_AMAX, F.lit(1.0)).otherwise(F.lit(top) / amax)
    return quantize(c, amax, bits, unsigned, narrow) / step


def fake_affine_quantize(c: Column, lo: Column, hi: Column, bits: int = 8) -> Column:
    """Quantise on a min/max range with a zero point and scale back."""
    step = (hi - lo) / (2.0**bits - 1)
    low, top = -(2.0 ** (bits - 1)), 2.0 ** (bits - 1) - 1
    zero = F.rint(lo / step) - low
    code = F.greatest(F.least(F.rint(c / step) - zero, F.lit(top)), F.lit(low))
    return (code + zero) * step


def topk_indices(arr: Column, k: int) -> Column:
    """Zero-based positions of the k largest values, first position first on ties."""
    keyed = F.transform(arr, lambda x, i: F.struct((-x).alias("neg"), i.alias("pos")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["pos"])


def topn_hit(arr: Column, label: Column, n: int) -> Column:
    """True when at most ``n`` scores reach the score of the true class."""
    return let(
        F.get(arr, label.cast("int")), lambda own: F.size(F.filter(arr, lambda x: x >= own)) <= n
    )


def concat_arrays(*cols: Column) -> Column:
    return F.concat(*cols)


def split_array(arr: Column, sizes: Sequence[int]) -> list[Column]:
    out, start = [], 1
    for size in sizes:
        out.append(F.slice(arr, start, size))
        start += size
    return out
