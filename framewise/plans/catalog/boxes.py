"""Box functions, decoders and anchor tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions import boxes as B
from framewise.functions.boxes import Box, Quad
from framewise.functions.skeletons import face_box, upper_body_box
from framewise.operators import anchors
from framewise.operators.dims import join_dim
from framewise.plans.registry import project, query, r, rs
from framewise.plans.views import Tables

KEYS = ("frame", "det_id")

def _a() -> Box:
    return Box.of()


def _b() -> Box:
    return Box.of("b_")


def sides(box: Box) -> dict:
    return dict(zip(Box._fields, box))


_W = "greatest(least(xmax, b_xmax) - greatest(xmin, b_xmin){p}, 0e0)"
_H = "greatest(least(ymax, b_ymax) - greatest(ymin, b_ymin){p}, 0e0)"
_INTER = f"({_W} * {_H})".format(p="")
_INTER1 = f"({_W} * {_H})".format(p=" + 1e0")
_AREA_A, _AREA_B = "((xmax - xmin) * (ymax - ymin))", "((b_xmax - b_xmin) * (b_ymax - b_ymin))"
_PIX_A = "((xmax - xmin + 1) * (ymax - ymin + 1))"
_PIX_B = "((b_xmax - b_xmin + 1) * (b_ymax - b_ymin + 1))"

project(
    "p1_iou", "v_pair", KEYS, lambda: {"iou": B.iou(_a(), _b())},
    {"iou": f"{_INTER} / ({_AREA_A} + {_AREA_B} - {_INTER} + 2.220446049250313e-16)"},
)
project(
    "p2_iou_pixel", "v_pair", KEYS,
    lambda: {"iou": B.iou(B.ordered(_a()), _b(), normalized=False)},
    {"iou": f"{_INTER1} / ({_PIX_A} + {_PIX_B} - {_INTER1})"},
)
project(
    "p3_overlap_fraction", "v_pair", KEYS, lambda: {"share": B.overlap_fraction(_a(), _b())},
    {"share": f"{_INTER} / ({_AREA_A} + 2.220446049250313e-16)"},
)
project(
    "p4_box_props", "v_det", KEYS,
    lambda: {
        "width": B.width(_a()), "height": B.height(_a()), "cx": B.center(_a())[0],
        "cy": B.center(_a())[1], "area": B.area(_a()), "valid": B.is_valid(_a()).cast("int"),
    },
    {
        "width": "xmax - xmin", "height": "ymax - ymin", "cx": "(xmin + xmax) / 2",
        "cy": "(ymin + ymax) / 2", "area": "(xmax - xmin) * (ymax - ymin)",
        "valid": "case when xmax > xmin and ymax > ymin then 1 else 0 end",
    },
)
project(
    "p5_enlarge_box", "v_det", KEYS, lambda: sides(B.enlarge(_a(), 1.25)),
    {
        "xmin": "xmin - 0.125e0 * (xmax - xmin)", "ymin": "ymin - 0.125e0 * (ymax - ymin)",
        "xmax": "xmax + 0.125e0 * (xmax - xmin)", "ymax": "ymax + 0.125e0 * (ymax - ymin)",
    },
)
_CW = (
    "case when xmax - xmin < 0.75e0 * (ymax - ymin) then 0.75e0 * (ymax - ymin) else xmax - xmin end"
)
_CH = (
    "case when xmax - xmin > 0.75e0 * (ymax - ymin) then (xmax - xmin) / 0.75e0 else ymax - ymin end"
)
project(
    "p6_crop_window", "v_det", KEYS, lambda: sides(B.crop_window(_a(), 0.75)),
    {
        "xmin": f"(xmin + xmax) / 2 - 0.625e0 * ({_CW})",
        "ymin": f"(ymin + ymax) / 2 - 0.625e0 * ({_CH})",
        "xmax": f"(xmin + xmax) / 2 + 0.625e0 * ({_CW})",
        "ymax": f"(ymin + ymax) / 2 + 0.625e0 * ({_CH})",
    },
)
project(
    "p7_flip_box", "v_det", KEYS,
    lambda: {
        **sides(B.flip_box(_a(), 848.0, 480.0)),
        "px": B.flip_point(_a().xmin, _a().ymin, 848.0, 480.0)[0],
        "py": B.flip_point(_a().xmin, _a().ymin, 848.0, 480.0)[1],
    },
    {
        "xmin": "848e0 - xmax", "ymin": "480e0 - ymax", "xmax": "848e0 - xmin",
        "ymax": "480e0 - ymin", "px": "848e0 - xmin", "py": "480e0 - ymin",
    },
)

# image sizes vary by row; the network input is 848 x 480
_SW, _SH = "(xmax * 2 + 100e0)", "(ymax * 2 + 60e0)"
_SCALE = f"least(848e0 / {_SW}, 480e0 / {_SH})"
_C01 = "greatest(least({} / 400e0, 1e0), 0e0)"


def _letterboxed(t: Tables) -> DataFrame:
    fit = B.letterbox(F.col("xmax") * 2.0 + 100.0, F.col("ymax") * 2.0 + 60.0, 848, 480)
    return t.v_det.withColumns({"x0": fit.x0, "y0": fit.y0, "scale": fit.scale})


project(
    "p8_letterbox", "v_det", KEYS,
    lambda: {
        "x0": F.col("x0"), "y0": F.col("y0"), "scale": F.col("scale"),
        **sides(
            B.unletterbox(
                Box(*(c / 400.0 for c in _a())), F.col("x0"), F.col("y0"), F.col("scale"), 848, 480
            )
        ),
    },
    {
        "x0": "x0", "y0": "y0", "scale": "scale",
        **{
            n: f"({_C01.format(n)} * {848 if n[0] == 'x' else 480} - {n[0]}0) / scale"
            for n in Box._fields
        },
    },
    source=_letterboxed,
    sql_from=f"(SELECT *, {_SCALE} AS scale, floor((848 - floor({_SW} * {_SCALE})) / 2e0) AS x0, "
    f"floor((480 - floor({_SH} * {_SCALE})) / 2e0) AS y0 FROM v_det)",
)
project(
    "p16_clip01", "v_det", KEYS,
    lambda: {n: B.clip01(c / 300.0 - 0.2) for n, c in sides(_a()).items()},
    {
        n: f"case when {n} / 300e0 - 0.2e0 < 0 then 0e0 when {n} / 300e0 - 0.2e0 > 1 then 1e0 "
        f"else {n} / 300e0 - 0.2e0 end"
        for n in Box._fields
    },
)

# ------------------------------------------------------------------ prior decoding
# 6 x 6 cells with 4 shapes: 144 anchors, each offset row has one of them
_PRIOR = dict(
    H=6, W=6, img_w=300.0, img_h=300.0, min_sizes=(60.0,), max_sizes=(111.0,),
    aspect_ratios=(1.0, 2.0, 0.5), step_w=50.0, step_h=50.0,
)
PRIORS_SQL = """priors AS (
  SELECT cell * 4 + shape AS anchor_id,
    ((cell % 6 + 0.5e0) * 50 - w / 2) / 300 AS xmin, ((cell // 6 + 0.5e0) * 50 - h / 2) / 300 AS ymin,
    ((cell % 6 + 0.5e0) * 50 + w / 2) / 300 AS xmax, ((cell // 6 + 0.5e0) * 50 + h / 2) / 300 AS ymax
  FROM range(36) c(cell), (VALUES (0, 60e0, 60e0), (1, sqrt(6660e0), sqrt(6660e0)),
    (2, 60 * sqrt(2e0), 60 / sqrt(2e0)), (3, 60 * sqrt(0.5e0), 60 / sqrt(0.5e0))) s(shape, w, h))"""


def with_priors(t: Tables) -> DataFrame:
    return join_dim(t.v_offset, anchors.prior_boxes(t.spark, **_PRIOR), ["anchor_id"])


def _loc() -> Quad:
    return Quad(*(F.col(f"o{i}") for i in range(4)))


def _var() -> Quad:
    return Quad(*(F.col(f"var{i}") for i in range(4)))


_V = ("0.1e0", "0.1e0", "0.2e0", "0.2e0")
_PW, _PH = "(p.xmax - p.xmin)", "(p.ymax - p.ymin)"
_FROM = "v_offset o JOIN priors p USING (anchor_id)"


def _decode(name: str, box: Callable[[], Box], sql: dict[str, str]) -> None:
    listed = ", ".join(f"{rs(sql[n])} AS {n}" for n in Box._fields)
    body = f"WITH {PRIORS_SQL} SELECT frame, det_id, {listed} FROM {_FROM}"
    query(name, body, ("v_offset",))(
        lambda t: with_priors(t).select(*KEYS, *(r(c).alias(n) for n, c in sides(box()).items()))
    )


_decode("p9_decode_corner", lambda: B.decode_boxes(_loc(), _a(), _var(), "corner"), {
    n: f"p.{n} + o{i} * {_V[i]}" for i, n in enumerate(Box._fields)
})


def _center_sql(o, sign: str, axis: int) -> str:
    size = (_PW, _PH)[axis]
    mid = ("(p.xmin + p.xmax) / 2", "(p.ymin + p.ymax) / 2")[axis]
    return f"({_V[axis]} * {o[axis]} * {size} + {mid}) {sign} exp({_V[axis + 2]} * {o[axis + 2]}) * {size} / 2"


def _center(o) -> dict[str, str]:
    return {
        "xmin": _center_sql(o, "-", 0), "ymin": _center_sql(o, "-", 1),
        "xmax": _center_sql(o, "+", 0), "ymax": _center_sql(o, "+", 1),
    }


_decode("p10_decode_center_size", lambda: B.decode_boxes(_loc(), _a(), _var(), "center_size", clip=True), {
    n: f"greatest(least({e}, 1e0), 0e0)" for n, e in _center(("o0", "o1", "o2", "o3")).items()
})
_decode("p11_decode_corner_size", lambda: B.decode_boxes(_loc(), _a(), None, "corner_size"), {
    n: f"p.{n} + o{i} * {(_PW, _PH)[i % 2]}" for i, n in enumerate(Box._fields)
})
_decode("p12_decode_tf_center", lambda: B.decode_boxes(_loc(), _a(), _var(), "tf_center"), _center(("o1", "o0", "o3", "o2")))

# region proposals on a 16 x 12 grid of cells with 9 base anchors
_BASE = dict(ratios=(0.5, 1.0, 2.0), scales=(2.0, 4.0, 8.0), base=16)
def _cell():
    return F.col("det_id") % 16, F.expr("(det_id div 16) % 12")


BASES_SQL = """bases AS (SELECT r * 3 + s AS base_id, 7.5e0 AS cx, 7.5e0 AS cy,
    round(sqrt(256e0 / ratio)) * scale AS w, round(round(sqrt(256e0 / ratio)) * ratio) * scale AS h
  FROM (VALUES (0, 0.5e0), (1, 1e0), (2, 2e0)) a(r, ratio), (VALUES (0, 2e0), (1, 4e0), (2, 8e0)) b(s, scale))"""
RPN_SQL = f"""{BASES_SQL}, moved AS (
  SELECT o.*, cx + (det_id % 16) * 16 + o0 * w AS mx, cy + ((det_id // 16) % 12) * 16 + o1 * h AS my,
    exp(o2) * w AS bw, exp(o3) * h AS bh
  FROM v_offset o JOIN bases b ON b.base_id = o.anchor_id % 9),
proposals AS (SELECT *, greatest(least(mx - bw / 2, 255e0), 0e0) AS xmin, greatest(least(my - bh / 2, 191e0), 0e0) AS ymin,
    greatest(least(mx + bw / 2, 255e0), 0e0) AS xmax, greatest(least(my + bh / 2, 191e0), 0e0) AS ymax FROM moved),
rpn AS (SELECT frame, det_id, label, xmin, ymin, xmax, ymax,
    CASE WHEN xmax - xmin + 1 < 40 OR ymax - ymin + 1 < 40 THEN NULL ELSE score END AS score FROM proposals)"""


def proposals(t: Tables) -> DataFrame:
    """Boxes and scores (NULL when too small) of all offset rows."""
    base = anchors.base_anchors(t.spark, **_BASE).withColumnRenamed("anchor_id", "base_id")
    rows = join_dim(t.v_offset.withColumn("base_id", F.col("anchor_id") % 9), base, ["base_id"])
    box, score = B.decode_rpn(
        _loc(), Quad(*(F.col(c) for c in ("cx", "cy", "w", "h"))), *_cell(), 16.0,
        256.0, 192.0, F.col("score"), 40.0,
    )
    return rows.select("frame", "det_id", "label", *box.columns(), score.alias("score"))


@query(
    "p13_decode_rpn",
    f"WITH {RPN_SQL} SELECT frame, det_id, {rs('xmin')} AS xmin, {rs('ymin')} AS ymin, "
    f"{rs('xmax')} AS xmax, {rs('ymax')} AS ymax, {rs('score')} AS score FROM rpn",
    ("v_offset",),
)
def _(t: Tables) -> DataFrame:
    return proposals(t).select(*KEYS, *(r(F.col(c)).alias(c) for c in (*Box._fields, "score")))


def _weighted() -> Box:
    loc = _loc()
    return B.decode_weighted(
        Quad(loc.a, loc.b, loc.c * 100.0, loc.d * 10.0), _a(), (10.0, 10.0, 5.0, 5.0), 448.0, 400.0, 4.135
    )


_AW, _AH = "(xmax - xmin + 1)", "(ymax - ymin + 1)"
_XC = f"(xmin + {_AW} * 0.5e0 + o0 / 10 * {_AW})"
_YC = f"(ymin + {_AH} * 0.5e0 + o1 / 10 * {_AH})"
_DW = f"(exp(least(o2 * 100 / 5, 4.135e0)) * {_AW})"
_DH = f"(exp(least(o3 * 10 / 5, 4.135e0)) * {_AH})"
_CLIPW, _CLIPH = "greatest(least({}, 447e0), 0e0)", "greatest(least({}, 399e0), 0e0)"


def _boxed_offsets(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        *(f"{e} AS {n}" for n, e in _det_offsets().items())
    )


def _det_offsets() -> dict[str, str]:
    from framewise.plans.views import PROJECTIONS

    det, off = PROJECTIONS["v_det"][1], PROJECTIONS["v_offset"][1]
    return {**det, **{k: off[k] for k in ("o0", "o1", "o2", "o3")}}


project(
    "p14_decode_weighted", "v_det", KEYS,
    lambda: sides(_weighted()),
    {
        "xmin": _CLIPW.format(f"{_XC} - 0.5e0 * {_DW}"), "ymin": _CLIPH.format(f"{_YC} - 0.5e0 * {_DH}"),
        "xmax": _CLIPW.format(f"{_XC} - 0.5e0 * {_DW} + {_DW} - 1"),
        "ymax": _CLIPH.format(f"{_YC} - 0.5e0 * {_DH} + {_DH} - 1"),
    },
    source=_boxed_offsets, views=(),
    sql_from="(SELECT " + ", ".join(f"{e} AS {n}" for n, e in _det_offsets().items()) + " FROM lineitem)",
)

# one grid cell per row: 4 box values, objectness, then the class scores
def _grid_cell() -> dict:
    box, score = B.decode_grid_cell(
        Quad(*(F.get("logits", F.lit(i)) for i in range(4))), F.get("logits", F.lit(4)),
        F.array_max(F.slice("logits", 6, 27)), F.col("vec_id") % 19, F.expr("(vec_id div 19) % 13"),
        19, 13, F.lit(116.0), F.lit(90.0), 608.0, 416.0,
    )
    return {"x": box.xmin, "y": box.ymin, "w": B.width(box), "h": B.height(box), "score": score}


_SIG = "(1 / (1 + exp(-({}))))"
_GW, _GH = "(exp(logits[3]) * 116 / 608)", "(exp(logits[4]) * 90 / 416)"
_GX = f"(({_SIG.format('logits[1]')} + vec_id % 19) / 19 - {_GW} / 2)"
_GY = f"(({_SIG.format('logits[2]')} + (vec_id // 19) % 13) / 13 - {_GH} / 2)"
project("p15_decode_grid", "v_logits", ("vec_id",), _grid_cell, {
    "x": _GX, "y": _GY, "w": _GW, "h": _GH,
    "score": f"{_SIG.format('logits[5]')} * {_SIG.format('list_max(logits[6:32])')}",
})


def _scaled() -> dict:
    box = B.decode_scaled(
        _loc(), (F.col("anchor_id") % 3 + 1) * 16.0, (F.expr("(anchor_id div 3) % 3") + 1) * 0.5,
        *_cell(), 16.0, 4.0,
    )
    return dict(zip(("ymin", "xmin", "ymax", "xmax"), B.normalize_box(box, 256.0, 192.0)))


_S_RATIO = "(0.5e0 * ((anchor_id // 3) % 3 + 1))"
_S_W, _S_H = f"(16 * (anchor_id % 3 + 1) * {_S_RATIO})", f"(16 * (anchor_id % 3 + 1) / {_S_RATIO})"
_S_CX = f"((det_id % 16 + 0.5e0) * 16 + {_S_W} * o0 / 4)"
_S_CY = f"(((det_id // 16) % 12 + 0.5e0) * 16 + {_S_H} * o1 / 4)"
project("p53_decode_scaled", "v_offset", KEYS, _scaled, {
    n: f"({(_S_CX, _S_CY)[n[0] == 'y']} {'-' if n.endswith('min') else '+'} "
    f"exp(o{3 if n[0] == 'y' else 2} / 4) * {(_S_W, _S_H)[n[0] == 'y']} / 2) / {255 if n[0] == 'x' else 191}"
    for n in ("ymin", "xmin", "ymax", "xmax")
})


# --------------------------------------------------------------------- anchors
def _anchor_use(t: Tables, table: DataFrame, columns: list[str]) -> DataFrame:
    """Every anchor with the number and mean score of the detections it serves."""
    n = table.count()
    used = (
        t.v_offset.groupBy((F.col("det_id") % n).alias("anchor_id"))
        .agg(F.count(F.lit(1)).alias("n_det"), r(F.avg("score")).alias("mean_score"))
    )
    return table.join(used, "anchor_id", "left").select(
        F.col("anchor_id").cast("long").alias("anchor_id"), *(r(F.col(c)).alias(c) for c in columns),
        F.coalesce("n_det", F.lit(0)).alias("n_det"), "mean_score",
    )


def _anchor_sql(cte: str, name: str, n: int, columns: list[str]) -> str:
    listed = ", ".join(f"{rs('a.' + c)} AS {c}" for c in columns)
    return f"""WITH {cte}, used AS (SELECT det_id % {n} AS anchor_id, count(*) AS n_det,
      {rs('avg(score)')} AS mean_score FROM v_offset GROUP BY 1)
    SELECT CAST(a.anchor_id AS BIGINT) AS anchor_id, {listed}, coalesce(u.n_det, 0) AS n_det, u.mean_score
    FROM {name} a LEFT JOIN used u ON u.anchor_id = a.anchor_id"""


_BOXC = list(Box._fields)
_GRID_SQL = """grid AS (SELECT cell * 2 + s AS anchor_id,
   (cell % 10 + 0.5e0) / 10 - w / 2 AS xmin, (cell // 10 + 0.5e0) / 8 - h / 2 AS ymin,
   (cell % 10 + 0.5e0) / 10 + w / 2 AS xmax, (cell // 10 + 0.5e0) / 8 + h / 2 AS ymax
   FROM range(80) c(cell), (VALUES (0, 0.2e0, 0.1e0), (1, 0.3e0, 0.4e0)) v(s, w, h))"""


@query("p18_grid_anchors", _anchor_sql(_GRID_SQL, "grid", 160, _BOXC), ("v_offset",))
def _(t: Tables) -> DataFrame:
    return _anchor_use(t, anchors.grid_anchors(t.spark, 8, 10, [0.2, 0.3], [0.1, 0.4]), _BOXC)


@query("p19_prior_boxes", _anchor_sql(PRIORS_SQL, "priors", 144, _BOXC), ("v_offset",))
def _(t: Tables) -> DataFrame:
    return _anchor_use(t, anchors.prior_boxes(t.spark, **_PRIOR), _BOXC)


@query(
    "p20_base_anchors",
    _anchor_sql(BASES_SQL.replace("base_id", "anchor_id"), "bases", 9, ["cx", "cy", "w", "h"]),
    ("v_offset",),
)
def _(t: Tables) -> DataFrame:
    return _anchor_use(t, anchors.base_anchors(t.spark, **_BASE), ["cx", "cy", "w", "h"])


# ------------------------------------------------------------- boxes of persons
def parts_of(t: Tables) -> DataFrame:
    """Persons as MAP<part, STRUCT<x, y, score>> in relative coordinates."""
    part = F.struct(
        ((F.col("x") + 60.0) / 120.0).alias("x"), ((F.col("y") + 60.0) / 120.0).alias("y"),
        (F.col("conf") * 3.0).alias("score"),
    )
    return t.v_kp.groupBy("person").agg(
        F.map_from_entries(F.collect_list(F.struct("kp_idx", part))).alias("parts")
    )


def _person_boxes_sql(w: str = "640e0", h: str = "480e0") -> str:
    """The three boxes by CASE arithmetic; slot 17 has no keypoint here."""
    slots = range(18)
    seen = ", ".join(
        f"max({c}) FILTER (kp_idx = {s} AND score > 0.{t}e0) AS {c}{t}_{s}" for s in slots for t in (2, 3) for c in "xy"
    )

    def fit(x: str, y: str, x2: str, y2: str) -> str:
        return (
            f"greatest({x}, 0e0) AS fx, greatest({y}, 0e0) AS fy, least({w} - greatest({x}, 0e0), {x2} - greatest({x}, 0e0)) + greatest({x}, 0e0) AS gx, "
            f"least({h} - greatest({y}, 0e0), {y2} - greatest({y}, 0e0)) + greatest({y}, 0e0) AS gy"
        )

    def boxed(name: str, centred: bool) -> str:
        good = "ok AND round_even(gx - fx, 0) <> 0 AND round_even(gy - fy, 0) <> 0"
        at = {"x": "(fx + gx) / 2" if centred else "fx", "y": "(fy + gy) / 2" if centred else "fy", "w": "gx - fx", "h": "gy - fy"}
        return ", ".join(f"CASE WHEN {good} THEN round_even({e}, 0) END AS {name}_{f}" for f, e in at.items())

    face = f"""SELECT *, x2_14 - x2_15 AS dx, y2_14 - y2_15 AS dy FROM m"""
    size = f"greatest(0e0, (y2_1 - y2_0) * {h} * 0.8e0, dx * {w} * 2, sqrt(dx * dx + dy * dy) * {w} * 2, (x2_16 - x2_17) * {w} * 1.6e0)"
    shift = """CASE WHEN x2_14 IS NULL AND x2_15 IS NOT NULL THEN floor(size / 3) * 2
      WHEN x2_14 IS NOT NULL AND x2_15 IS NULL THEN floor(size / 3) ELSE floor(size / 2) END"""
    parts = []
    for name, up, extra in (
        ("face", "floor(size / 3)", ""), ("head", "round_even(size / 2 * 1.2e0, 0)", " AND (x2_14 IS NOT NULL OR x2_15 IS NOT NULL)")
    ):
        parts.append(
            f"{name} AS (SELECT person, {boxed(name, name == 'face')} FROM (SELECT person, x2_0 IS NOT NULL AND size > 0{extra} AS ok, "
            f"{fit('x', 'y', '(x + size)', '(y + size)')} FROM (SELECT *, x2_0 * {w} - {shift} AS x, y2_0 * {h} - {up} AS y FROM "
            f"(SELECT *, {size} AS size FROM ({face})))))"
        )
    listed = {c: "[" + ", ".join(f"{c}3_{s}" for s in (0, 1, 2, 5, 8, 11, 14, 15, 16, 17)) + "]" for c in "xy"}
    one = f"coalesce(CASE WHEN x3_2 IS NULL THEN abs(x3_5 - x3_1) END, CASE WHEN x3_5 IS NULL THEN abs(x3_2 - x3_1) END) * ({w} * 1.15e0)"
    both = "x3_2 IS NOT NULL AND x3_5 IS NOT NULL"
    parts.append(
        f"upper_box AS (SELECT person, {boxed('upper', True)} FROM (SELECT person, n >= 5 AS ok, {fit('l', 't', 'r', 'y1')} FROM "
        f"(SELECT *, CASE WHEN {both} THEN x0 - (x1 - x0) * 0.15e0 ELSE least(x0, x3_1 * {w} - {one}) END AS l, "
        f"CASE WHEN {both} THEN x1 + (x1 - x0) * 0.15e0 ELSE greatest(x1, x3_1 * {w} + {one}) END AS r, "
        f"CASE WHEN x3_0 IS NOT NULL AND x3_1 IS NOT NULL THEN y0 - (y3_1 * {h} - y0) * 0.8e0 ELSE y0 END AS t FROM "
        f"(SELECT *, list_min({listed['x']}) * {w} AS x0, list_max({listed['x']}) * {w} AS x1, list_min({listed['y']}) * {h} AS y0, "
        f"list_max({listed['y']}) * {h} AS y1, list_count({listed['x']}) AS n FROM m))))"
    )
    return (
        "WITH p AS (SELECT person, kp_idx, (x + 60e0) / 120e0 AS x, (y + 60e0) / 120e0 AS y, conf * 3e0 AS score FROM v_kp), "
        f"m AS (SELECT person, {seen} FROM p GROUP BY person), {', '.join(parts)} "
        "SELECT * FROM face JOIN head USING (person) JOIN upper_box USING (person)"
    )


@query("p17_person_boxes", _person_boxes_sql(), ("v_kp",))
def _(t: Tables) -> DataFrame:
    parts = parts_of(t)
    boxes = {
        "face": face_box(F.col("parts"), 640.0, 480.0), "head": face_box(F.col("parts"), 640.0, 480.0, 1),
        "upper": upper_body_box(F.col("parts"), 640.0, 480.0),
    }
    return parts.select("person", *(c.alias(n) for n, c in boxes.items())).select(
        "person", *(F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in boxes for f in "xywh")
    )


_JOINT_HULL = """WITH boxes AS (SELECT person, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax,
   min(x2) FILTER (hidden) AS hx0, min(y2) FILTER (hidden) AS hy0, max(x2) FILTER (hidden) AS hx1,
   max(y2) FILTER (hidden) AS hy1 FROM v_kp GROUP BY person)
SELECT person, """ + ", ".join(
    f"{rs(f'{fn}({n}, coalesce({h}, {n}))')} AS {n}"
    for fn, n, h in (("least", "xmin", "hx0"), ("least", "ymin", "hy0"), ("greatest", "xmax", "hx1"), ("greatest", "ymax", "hy1"))
) + " FROM boxes"


@query("p52_extend_box", _JOINT_HULL, ("v_kp",))
def _(t: Tables) -> DataFrame:
    xs, ys = F.transform("kps", lambda k: k["x"]), F.transform("kps", lambda k: k["y"])
    box = Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    out = B.extend_box_by_joints(box, F.col("kps2"))
    return t.persons.select("person", *(r(c).alias(n) for n, c in sides(out).items()))
