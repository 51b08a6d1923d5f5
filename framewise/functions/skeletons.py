"""Functions on keypoint arrays: ARRAY<STRUCT<x, y, conf, cov_xx, cov_xy, cov_yy>>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewise.functions.boxes import EPS

# Per-joint constants (2 * sigma)^2 of the keypoint similarity,
# nose, eyes, ears, shoulders, elbows, wrists, hips, knees, ankles (left, right).
KAPPAS_17 = (
    0.0027, 0.0025, 0.0025, 0.0049, 0.0049, 0.025, 0.025, 0.0207, 0.0207,
    0.0154, 0.0154, 0.0458, 0.0458, 0.0303, 0.0303, 0.0317, 0.0317,
)
# Sigmas of the 18-part order used by the tracker.
SIGMAS_18 = (
    0.026, 0.079, 0.079, 0.072, 0.062, 0.079, 0.072, 0.062, 0.107,
    0.087, 0.089, 0.107, 0.087, 0.089, 0.025, 0.025, 0.035, 0.035,
)
# Depth noise of a joint, metres.
DEPTH_SIGMA_MIN, DEPTH_SIGMA_MAX = 0.15, 0.75
DEPTH_SIGMA_STEEPNESS, DEPTH_SIGMA_MIDDLE = 20.0, 0.65


def oks(a: Column, b: Column, size: Column, kappas: Sequence[float] = KAPPAS_17) -> Column:
    """Object keypoint similarity of two keypoint arrays; ``size`` is the area of ``a``.

    1 when the area is not positive, 0 when no keypoint is present in both.
    """
    weights = F.array(*(F.lit(float(k)) for k in kappas))
    both = F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    terms = F.zip_with(
        both,
        weights,
        lambda t, k: F.when(
            (t["p"]["conf"] > 0) & (t["q"]["conf"] > 0),
            F.exp(
                -(
                    (t["p"]["x"] - t["q"]["x"]) * (t["p"]["x"] - t["q"]["x"])
                    + (t["p"]["y"] - t["q"]["y"]) * (t["p"]["y"] - t["q"]["y"])
                )
                / (size * 2.0 * k)
            ),
        ),
    )
    shared = F.filter(terms, lambda x: x.isNotNull())
    mean = F.aggregate(shared, F.lit(0.0), lambda acc, x: acc + x) / F.size(shared)
    return F.when(size <= 0, F.lit(1.0)).when(F.size(shared) == 0, F.lit(0.0)).otherwise(mean)


def oks_padded(a: Column, b: Column, size: Column, sigmas: Sequence[float] = SIGMAS_18) -> Column:
    """Variant of the tracker: kappa = (2 sigma)^2 and an area that is never zero."""
    return oks(a, b, size + EPS, [(2.0 * s) ** 2 for s in sigmas])


def depth_sigma(c: Column, conf: Column) -> Column:
    """Depth noise by joint confidence, a falling logistic."""
    x = F.least(c, c / conf)
    return (DEPTH_SIGMA_MAX - DEPTH_SIGMA_MIN) / (
        1.0 + F.exp((x - DEPTH_SIGMA_MIDDLE) * DEPTH_SIGMA_STEEPNESS)
    ) + DEPTH_SIGMA_MIN


_KP = ("x", "y", "conf", "cov_xx", "cov_xy", "cov_yy")


def _midpoint(a: Column, b: Column) -> Column:
    ok = (a["conf"] > 0) & (b["conf"] > 0)
    return F.struct(
        *(F.when(ok, (a[n] + b[n]) / 2.0).otherwise(F.lit(0.0)).alias(n) for n in _KP)
    )


def midpoint_joints(
    kps: Column, shoulders=(5, 6), hips=(11, 12), neck: int = 1, root: int = 2
) -> Column:
    """Slots ``neck`` and ``root`` become the midpoints of shoulders and hips."""
    def at(i: int) -> Column:
        return F.element_at(kps, i + 1)

    new = {neck: _midpoint(*map(at, shoulders)), root: _midpoint(*map(at, hips))}

    def plain(k: Column) -> Column:
        return F.struct(*(k[n].cast("double").alias(n) for n in _KP))

    return F.transform(
        kps,
        lambda k, i: F.when(i == neck, new[neck]).when(i == root, new[root]).otherwise(plain(k)),
    )


def remap_joints(kps: Column, order: Sequence[int]) -> Column:
    """Joints picked by an index list; a missing one is (0, 0) and not visible."""
    idx = F.array(*(F.lit(int(i)) for i in order))

    def pick(i: Column) -> Column:
        # i + 1 is never 0 for a listed joint; negative entries stand for "none"
        k = F.when(i >= 0, F.get(kps, i))
        seen = F.coalesce(k["conf"] > 0, F.lit(False))
        return F.struct(
            F.when(seen, k["x"]).otherwise(F.lit(0.0)).alias("x"),
            F.when(seen, k["y"]).otherwise(F.lit(0.0)).alias("y"),
            seen.alias("visible"),
        )

    return F.transform(idx, pick)


def _whole(c: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(c)


def _fit(x, y, x2, y2, W: float, H: float):
    """Clamp a box to the image, corner first and then the size."""
    fx, fy = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    gx = F.least(F.lit(W) - fx, x2 - fx) + fx
    gy = F.least(F.lit(H) - fy, y2 - fy) + fy
    return fx, fy, gx, gy


def _boxed(x, y, x2, y2, ok: Column, centred: bool) -> Column:
    """Rounded result struct, NULL when a rule failed or a side rounds to zero."""
    w, h = _whole(x2 - x), _whole(y2 - y)
    left = (x + x2) / 2.0 if centred else x
    top = (y + y2) / 2.0 if centred else y
    full = F.struct(
        _whole(left).alias("x"),
        _whole(top).alias("y"),
        w.alias("w"),
        h.alias("h"),
    )
    return F.when(ok & (w != 0) & (h != 0), full)


# Slots of the 18-part order.
NOSE, NECK, R_SHOULDER, L_SHOULDER = 0, 1, 2, 5
R_EYE, L_EYE, R_EAR, L_EAR = 14, 15, 16, 17
UPPER_BODY_PARTS = (0, 1, 2, 5, 8, 11, 14, 15, 16, 17)


def _seen(parts: Column, slot: int, threshold: float) -> Column:
    part = F.element_at(parts, slot)
    return F.when(part["score"] > threshold, part)


def face_box(parts: Column, W: float, H: float, mode: int = 0) -> Column:
    """Face box from MAP<part, STRUCT<x, y, score>> in relative coordinates.

    The size is the largest of the scaled nose-neck, eye and ear distances.
    """
    nose, neck, reye, leye, rear, lear = (
        _seen(parts, s, 0.2) for s in (NOSE, NECK, R_EYE, L_EYE, R_EAR, L_EAR)
    )
    dx = reye["x"] - leye["x"]
    dy = reye["y"] - leye["y"]
    # greatest skips NULL, so absent pairs simply do not take part
    size = F.greatest(
        F.lit(0.0),
        (neck["y"] - nose["y"]) * H * 0.8,
        dx * W * 2.0,
        F.sqrt(dx * dx + dy * dy) * W * 2.0,
        (rear["x"] - lear["x"]) * W * 1.6,
    )
    third = F.floor(size / 3.0)
    shift = (
        F.when(reye.isNull() & leye.isNotNull(), third * 2.0)
        .when(reye.isNotNull() & leye.isNull(), third)
        .otherwise(F.floor(size / 2.0))
    )
    x = nose["x"] * W - shift
    up = third if mode == 0 else _whole(size / 2.0 * 1.2)
    y = nose["y"] * H - up
    ok = nose.isNotNull() & (size > 0)
    if mode == 1:
        ok = ok & (reye.isNotNull() | leye.isNotNull())
    return _boxed(*_fit(x, y, x + size, y + size, W, H), ok, centred=mode == 0)


def upper_body_box(parts: Column, W: float, H: float) -> Column:
    """Upper-body box from the same map: hull of the parts, then adjusted."""
    limit = 0.3
    hull = F.filter(
        F.array(*(_seen(parts, s, limit) for s in UPPER_BODY_PARTS)), lambda p: p.isNotNull()
    )
    xs = F.transform(hull, lambda p: p["x"] * W)
    ys = F.transform(hull, lambda p: p["y"] * H)
    x, y, x2, y2 = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    nose, neck, rs, ls = (_seen(parts, s, limit) for s in (NOSE, NECK, R_SHOULDER, L_SHOULDER))
    top = F.when(nose.isNotNull() & neck.isNotNull(), y - (neck["y"] * H - y) * 0.8).otherwise(y)
    both = rs.isNotNull() & ls.isNotNull()
    pad = (x2 - x) * 0.15
    one = F.coalesce(
        F.when(rs.isNull(), F.abs(ls["x"] - neck["x"])),
        F.when(ls.isNull(), F.abs(rs["x"] - neck["x"])),
    ) * (W * 1.15)
    left = F.when(both, x - pad).otherwise(F.least(x, neck["x"] * W - one))
    right = F.when(both, x2 + pad).otherwise(F.greatest(x2, neck["x"] * W + one))
    return _boxed(*_fit(left, top, right, y2, W, H), F.size(hull) >= 5, centred=True)


def accepted(kps: Column) -> Column:
    return F.filter(kps, lambda k: k["conf"] > 0)


def skeleton_box(kps: Column) -> Column:
    """Hull of the accepted keypoints as a struct, NULL when there is none."""
    ok = accepted(kps)
    xs, ys = F.transform(ok, lambda k: k["x"]), F.transform(ok, lambda k: k["y"])
    return F.when(
        F.size(ok) > 0,
        F.struct(
            F.array_min(xs).alias("xmin"),
            F.array_min(ys).alias("ymin"),
            F.array_max(xs).alias("xmax"),
            F.array_max(ys).alias("ymax"),
        ),
    )
