"""Box arithmetic. A box is four DOUBLE columns, so scans prune and codegen holds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the guard added to a denominator, the spacing of doubles at 1.
EPS = 2.220446049250313e-16


class Box(NamedTuple):
    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @classmethod
    def of(cls, prefix: str = "", table: str | None = None) -> "Box":
        at = f"{table}." if table else ""
        return cls(*(F.col(f"{at}{prefix}{n}") for n in cls._fields))

    @classmethod
    def field(cls, struct: Column) -> "Box":
        """The box inside a struct column or a lambda variable."""
        return cls(*(struct[n] for n in cls._fields))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(self._fields, self)]

    def struct(self) -> Column:
        return F.struct(*self.columns())


def _zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def width(b: Box) -> Column:
    return b.xmax - b.xmin


def height(b: Box) -> Column:
    return b.ymax - b.ymin


def center(b: Box) -> tuple[Column, Column]:
    return (b.xmin + b.xmax) * 0.5, (b.ymin + b.ymax) * 0.5


def area(b: Box, clamp: bool = True) -> Column:
    if clamp:
        return _zero(width(b)) * _zero(height(b))
    return width(b) * height(b)


def is_valid(b: Box) -> Column:
    return (width(b) > 0) & (height(b) > 0)


def ordered(b: Box) -> Box:
    """Corners swapped so that min <= max."""
    return Box(
        F.least(b.xmin, b.xmax),
        F.least(b.ymin, b.ymax),
        F.greatest(b.xmin, b.xmax),
        F.greatest(b.ymin, b.ymax),
    )


def intersection(a: Box, b: Box, pixel: float = 0.0) -> Column:
    w = F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin) + pixel
    h = F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin) + pixel
    return _zero(w) * _zero(h)


def iou(a: Box, b: Box, normalized: bool = True) -> Column:
    """Intersection over union; ``normalized=False`` counts inclusive pixels."""
    if normalized:
        inter = intersection(a, b)
        return inter / (area(a) + area(b) - inter + EPS)
    inter = intersection(a, b, 1.0)
    size_a = (width(a) + 1.0) * (height(a) + 1.0)
    size_b = (width(b) + 1.0) * (height(b) + 1.0)
    return inter / (size_a + size_b - inter)


def overlap_fraction(a: Box, b: Box) -> Column:
    """Share of ``a`` that lies inside ``b``."""
    return intersection(a, b) / (area(a) + EPS)


def pixel_overlap_of_second(a: Box, b: Box) -> Column:
    """Share of ``b`` covered by ``a``, inclusive pixels."""
    return intersection(a, b, 1.0) / ((width(b) + 1.0) * (height(b) + 1.0))


def enlarge(b: Box, factor: float = 1.25) -> Box:
    k = (factor - 1.0) / 2.0
    dx, dy = width(b) * k, height(b) * k
    return Box(b.xmin - dx, b.ymin - dy, b.xmax + dx, b.ymax + dy)


def crop_window(b: Box, aspect: float, factor: float = 1.25) -> Box:
    """Pad the short side to ``aspect`` (width / height), then scale about the centre."""
    w, h = width(b), height(b)
    cx, cy = b.xmin + w * 0.5, b.ymin + h * 0.5
    full_w = F.greatest(w, h * aspect) * (factor * 0.5)
    full_h = F.greatest(h, w / aspect) * (factor * 0.5)
    return Box(cx - full_w, cy - full_h, cx + full_w, cy + full_h)


def flip_point(x: Column, y: Column, W, H) -> tuple[Column, Column]:
    return F.lit(W) - x, F.lit(H) - y


def flip_box(b: Box, W, H) -> Box:
    """Half a turn of the image."""
    x0, y0 = flip_point(b.xmax, b.ymax, W, H)
    x1, y1 = flip_point(b.xmin, b.ymin, W, H)
    return Box(x0, y0, x1, y1)


class Letterbox(NamedTuple):
    x0: Column
    y0: Column
    scale: Column
    width: Column
    height: Column


def letterbox(W, H, w: int, h: int) -> Letterbox:
    """Fit a W x H image into w x h: scale, integer size and centred padding."""
    W, H = F.lit(W), F.lit(H)
    scale = F.least(F.lit(float(w)) / W, F.lit(float(h)) / H)
    new_w, new_h = F.floor(W * scale), F.floor(H * scale)
    return Letterbox(
        F.floor((F.lit(w) - new_w) / 2), F.floor((F.lit(h) - new_h) / 2), scale, new_w, new_h
    )


def unletterbox(b: Box, x0: Column, y0: Column, scale: Column, w: int, h: int) -> Box:
    """Normalised box of the padded image to pixels of the original; clamps first."""
    c = Box(*(clip01(v) for v in b))
    return Box(
        (c.xmin * w - x0) / scale,
        (c.ymin * h - y0) / scale,
        (c.xmax * w - x0) / scale,
        (c.ymax * h - y0) / scale,
    )


def clip01(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def clip_box(b: Box, W, H) -> Box:
    """Clamp to 0 .. W-1 and 0 .. H-1."""

    def fit(c: Column, top) -> Column:
        return F.greatest(F.least(c, F.lit(top) - 1.0), F.lit(0.0))

    return Box(fit(b.xmin, W), fit(b.ymin, H), fit(b.xmax, W), fit(b.ymax, H))


def normalize_box(b: Box, W, H) -> list[Column]:
    """(ymin, xmin, ymax, xmax) over (size - 1)."""
    sx, sy = F.lit(W) - 1.0, F.lit(H) - 1.0
    return [
        (b.ymin / sy).alias("ymin"),
        (b.xmin / sx).alias("xmin"),
        (b.ymax / sy).alias("ymax"),
        (b.xmax / sx).alias("xmax"),
    ]


class Quad(NamedTuple):
    """Four offsets or four variances, in the order of the encoding."""

    a: Column
    b: Column
    c: Column
    d: Column


def _from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def decode_boxes(loc: Quad, prior: Box, var: Quad | None, code: str, clip: bool = False) -> Box:
    """Offsets against a prior box.

    ``code``: ``corner``, ``center_size``, ``corner_size`` or ``tf_center``.
    ``var=None`` means the variance is already part of the offsets.
    """
    pw, ph = width(prior), height(prior)
    scaled = loc if var is None else Quad(*(v * o for v, o in zip(var, loc)))
    if code == "corner":
        out = Box(*(p + o for p, o in zip(prior, scaled)))
    elif code == "corner_size":
        out = Box(*(p + o * s for p, o, s in zip(prior, scaled, (pw, ph, pw, ph))))
    elif code in ("center_size", "tf_center"):
        if code == "tf_center":
            if var is None:
                raise ValueError("tf_center always applies the variance")
            # offsets come as y, x, h, w while the variances stay x, y, w, h
            scaled = Quad(loc.b * var.a, loc.a * var.b, loc.d * var.c, loc.c * var.d)
        pcx, pcy = center(prior)
        out = _from_center(
            scaled.a * pw + pcx, scaled.b * ph + pcy, F.exp(scaled.c) * pw, F.exp(scaled.d) * ph
        )
    else:
        raise ValueError(f"unknown box code {code!r}")
    return Box(*(clip01(c) for c in out)) if clip else out


def decode_rpn(
    delta: Quad, anchor: Quad, cell_x: Column, cell_y: Column, stride: float, W, H,
    score: Column, min_size: float, scale: float = 1.0,
) -> tuple[Box, Column]:
    """Proposal of one anchor (cx, cy, w, h) at one cell; the score is NULL when too small."""
    cx = anchor.a + cell_x * stride + delta.a * anchor.c
    cy = anchor.b + cell_y * stride + delta.b * anchor.d
    box = clip_box(
        _from_center(cx, cy, F.exp(delta.c) * anchor.c, F.exp(delta.d) * anchor.d), W, H
    )
    least = min_size * scale
    small = (width(box) + 1.0 < least) | (height(box) + 1.0 < least)
    return box, F.when(~small, score)


def decode_weighted(delta: Quad, anchor: Box, weights, W, H, cap: float) -> Box:
    """Deltas (dx, dy, dw, dh) over weights, capped log sizes, inclusive pixels."""
    wx, wy, ww, wh = weights
    aw, ah = width(anchor) + 1.0, height(anchor) + 1.0
    cx = anchor.xmin + aw * 0.5 + delta.a / wx * aw
    cy = anchor.ymin + ah * 0.5 + delta.b / wy * ah
    w = F.exp(F.least(delta.c / ww, F.lit(cap))) * aw
    h = F.exp(F.least(delta.d / wh, F.lit(cap))) * ah
    x0, y0 = cx - w * 0.5, cy - h * 0.5
    return clip_box(Box(x0, y0, x0 + w - 1.0, y0 + h - 1.0), W, H)


def decode_scaled(
    delta: Quad, size: Column, ratio: Column, cell_x: Column, cell_y: Column,
    stride: float, std: float,
) -> Box:
    """Offsets divided by ``std``; the anchor is size*ratio by size/ratio at the cell centre."""
    aw, ah = size * ratio, size / ratio
    cx = (cell_x + 0.5) * stride + aw * (delta.a / std)
    cy = (cell_y + 0.5) * stride + ah * (delta.b / std)
    return _from_center(cx, cy, F.exp(delta.c / std) * aw, F.exp(delta.d / std) * ah)


def decode_grid_cell(
    raw: Quad, objectness: Column, best_class: Column, col: Column, row: Column,
    grid_w, grid_h, anchor_w: Column, anchor_h: Column, input_w, input_h,
) -> tuple[Box, Column]:
    """One grid cell: sigmoid centre + cell index, exp size * anchor; top-left form out.

    The box comes as xmin, ymin, width, height in the Box slots' order
    (xmax and ymax are the far corners); the score is sigmoid(obj) * sigmoid(class).
    """
    def logistic(c: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-c))

    cx = (logistic(raw.a) + col) / grid_w
    cy = (logistic(raw.b) + row) / grid_h
    w = F.exp(raw.c) * anchor_w / input_w
    h = F.exp(raw.d) * anchor_h / input_h
    x0, y0 = cx - w / 2, cy - h / 2
    return Box(x0, y0, x0 + w, y0 + h), logistic(objectness) * logistic(best_class)


def extend_box_by_joints(b: Box, kps: Column) -> Box:
    """Widen a box so that it covers the joints marked ``occluded`` in ``kps``.

    ``kps`` is an array of structs with x, y and a boolean occluded.
    """
    hidden = F.filter(kps, lambda k: k["occluded"])
    xs, ys = F.transform(hidden, lambda k: k["x"]), F.transform(hidden, lambda k: k["y"])
    # least and greatest skip NULL, so a person without such joints keeps the box
    return Box(
        F.least(b.xmin, F.array_min(xs)),
        F.least(b.ymin, F.array_min(ys)),
        F.greatest(b.xmax, F.array_max(xs)),
        F.greatest(b.ymax, F.array_max(ys)),
    )
