"""Geometry, score, tensor and skeleton functions (P21-P46), and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions import arrays as R
from framewise.functions import geometry as G
from framewise.functions import skeletons as S
from framewise.functions.boxes import Box
from framewise.functions.geometry import Intrinsics, Rigid
from framewise.operators import filters as flt
from framewise.operators.aggregate import standardize
from framewise.operators.clouds import label_plane
from framewise.operators.dims import join_dim, map_label
from framewise.operators.spatial import with_calibration
from framewise.plans.registry import project, query, r, rs
from framewise.plans.views import Tables

# ----------------------------------------------------------------- calibration
# one row per camera, cameras 0..3, derived from the nation table's first keys
CAMERA_SQL = """cams AS (SELECT CAST(n_nationkey AS BIGINT) AS camera, 600e0 + n_nationkey AS fx,
   605e0 - n_nationkey AS fy, 424e0 + n_nationkey * 0.5e0 AS cx, 240e0 - n_nationkey * 0.25e0 AS cy
   FROM nation WHERE n_nationkey < 4)"""
# a small turn about z and a shift, per camera
MOVE_SQL = """moves AS (SELECT CAST(n_nationkey AS BIGINT) AS camera, cos(0.01e0 * n_nationkey) AS r00,
   -sin(0.01e0 * n_nationkey) AS r01, sin(0.01e0 * n_nationkey) AS r10, cos(0.01e0 * n_nationkey) AS r11,
   0.05e0 * n_nationkey AS t0, 0.02e0 AS t1, 0.01e0 AS t2 FROM nation WHERE n_nationkey < 4)"""


def cameras(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return t.nation.filter(k < 4).select(
        k.cast("long").alias("camera"), (k + 600.0).alias("fx"), (F.lit(605.0) - k).alias("fy"),
        (k * 0.5 + 424.0).alias("cx"), (F.lit(240.0) - k * 0.25).alias("cy"),
    )


def moves(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    c, s = F.cos(k * 0.01), F.sin(k * 0.01)
    one, zero = F.lit(1.0), F.lit(0.0)
    r3 = (c, -s, zero, s, c, zero, zero, zero, one)
    return t.nation.filter(k < 4).select(
        k.cast("long").alias("camera"),
        *(v.alias(f"r{i // 3}{i % 3}") for i, v in enumerate(r3)),
        (k * 0.05).alias("t0"), F.lit(0.02).alias("t1"), F.lit(0.01).alias("t2"),
    )


def calibrated(t: Tables) -> DataFrame:
    return with_calibration(t.v_depth, cameras(t), moves(t))


_CALIB = f"WITH {CAMERA_SQL}, {MOVE_SQL} "
_CALIB_FROM = "v_depth JOIN cams USING (camera) JOIN moves USING (camera)"
_X, _Y, _Z = "((u - cx) / fx * (d / 1000e0))", "((v - cy) / fy * (d / 1000e0))", "(d / 1000e0)"
_MX, _MY, _MZ = f"(r00 * {_X} + r01 * {_Y} + t0)", f"(r10 * {_X} + r11 * {_Y} + t1)", f"({_Z} + t2)"
POINT_SQL = {"x": _X, "y": _Y, "z": _Z}
PIXEL_SQL = {"pu": f"(fx * {_MX} + cx * {_MZ}) / {_MZ}", "pv": f"(fy * {_MY} + cy * {_MZ}) / {_MZ}"}
_KEYS = ("frame", "pt_id", "camera")


def _calib_query(name: str, columns, sql: dict[str, str], where: str = "") -> None:
    listed = ", ".join([*_KEYS, *(f"{rs(e)} AS {n}" for n, e in sql.items())])
    query(name, f"{_CALIB} SELECT {listed} FROM {_CALIB_FROM} {where}", ("v_depth",))(
        lambda t: calibrated(t).select(*_KEYS, *(r(c).alias(n) for n, c in columns().items()))
    )


def _point():
    return G.back_project(F.col("u"), F.col("v"), F.col("d"), Intrinsics.of())


_calib_query(
    "s3_with_calibration",
    lambda: {n: F.col(n) for n in ("fx", "fy", "cx", "cy", "r00", "r01", "t0")},
    {n: n for n in ("fx", "fy", "cx", "cy", "r00", "r01", "t0")},
)
_calib_query("p21_back_project", lambda: dict(zip("xyz", _point())), POINT_SQL)
_calib_query(
    "p22_project",
    lambda: dict(zip(("pu", "pv"), G.project(_point(), Intrinsics.of(), Rigid.of()))),
    PIXEL_SQL,
)


@query(
    "p23_project_box",
    f"{_CALIB}, b AS (SELECT *, l.camera2 AS camera FROM (SELECT *, det_id % 4 AS camera2, 1e0 + score * 5 AS zz FROM v_det) l) "
    "SELECT frame, det_id, "
    + ", ".join(
        rs(
            f"{f} * ({ra} * (({x} - cx) / fx * zz) + {rb} * (({y} - cy) / fy * zz) + {tt}) / (zz + t2) + {c}"
        ) + f" AS {n}"
        for n, f, ra, rb, tt, c, x, y in (
            ("xmin", "fx", "r00", "r01", "t0", "cx", "xmin", "ymin"),
            ("ymin", "fy", "r10", "r11", "t1", "cy", "xmin", "ymin"),
            ("xmax", "fx", "r00", "r01", "t0", "cx", "xmax", "ymax"),
            ("ymax", "fy", "r10", "r11", "t1", "cy", "xmax", "ymax"),
        )
    )
    + " FROM b JOIN cams ON cams.camera = b.camera2 JOIN moves ON moves.camera = b.camera2",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    rows = with_calibration(t.v_det.withColumn("camera", F.col("det_id") % 4), cameras(t), moves(t))
    k = Intrinsics.of()
    box = G.project_box(Box.of(), F.col("score") * 5.0 + 1.0, k, Rigid.of(), k)
    return rows.select("frame", "det_id", *(r(c).alias(n) for n, c in zip(Box._fields, box)))


# ---------------------------------------------------------------------- planes
PLANE = (0.0, -0.98, -0.19, 1.5)
_PLANE_SQL = "abs(0e0 * x + -0.98e0 * y + -0.19e0 * z + 1.5e0)"


@query(
    "p24_plane_distance",
    f"SELECT frame, pt_id, {rs(_PLANE_SQL)} AS dist, {_PLANE_SQL} < 0.13e0 AS is_floor, "
    f"CASE WHEN {_PLANE_SQL} < 0.13e0 THEN 1e0 END AS p_floor FROM v_pts",
    ("v_pts",),
)
def _(t: Tables) -> DataFrame:
    x, y, z = (F.col(a) for a in "xyz")
    return label_plane(t.v_pts, PLANE, 0.13).select(
        "frame", "pt_id", r(G.plane_distance(x, y, z, PLANE)).alias("dist"), "is_floor",
        F.get("probs", F.lit(2)).alias("p_floor"),
    )


project(
    "p25_eig2_max", "v_kp", ("person", "kp_idx"),
    lambda: {"eig": G.eig2_max(F.col("cov_xx"), F.col("cov_xy"), F.col("cov_yy"))},
    {
        "eig": "((cov_xx + cov_yy) + sqrt(power(cov_xx + cov_yy, 2) "
        "- 4 * (cov_xx * cov_yy - cov_xy * cov_xy))) / 2"
    },
)
project(
    "p26_gaussian_2d", "v_kp", ("person", "kp_idx"),
    lambda: {
        "full": G.gaussian_2d(
            F.col("x") / 10, F.col("y") / 10, F.col("cov_xx"), F.col("cov_yy"), F.col("cov_xy")
        ),
        "apart": G.gaussian_separable(
            F.col("x") / 10, F.col("y") / 10, F.col("cov_xx"), F.col("cov_yy")
        ),
    },
    {
        "full": "exp(-0.5e0 * (cov_yy * x * x / 100 - 2 * cov_xy * x * y / 100 + cov_xx * y * y / 100) "
        "/ (cov_xx * cov_yy - cov_xy * cov_xy))",
        "apart": "exp(-x * x / 100 / (2 * cov_xx * cov_xx) - y * y / 100 / (2 * cov_yy * cov_yy))",
    },
)
project(
    "p27_in_box_weight", "v_pair", ("frame", "det_id"),
    lambda: {
        n: G.in_box_weight(F.col("b_xmin"), F.col("b_ymin"), Box.of(), F.col("score"), k)
        for n, k in (("colour", 0.5), ("thermal", 0.75))
    },
    {
        n: f"exp(-0.5e0 * (power((b_xmin - (xmin + xmax) / 2) / ((xmax - xmin) * {k}), 2) + "
        f"power((b_ymin - (ymin + ymax) / 2) / ((ymax - ymin) * {k}), 2))) * score"
        for n, k in (("colour", "0.5e0"), ("thermal", "0.75e0"))
    },
)


# ---------------------------------------------------------------------- arrays
def array_query(name: str, column, sql: str, view: str = "v_logits", keys=("vec_id",)) -> None:
    """Check an array result element by element; ``sql`` is a list expression."""
    listed = ", ".join(keys)
    body = f"""SELECT {listed}, pos, {rs('val')} AS val FROM (
      SELECT {listed}, unnest(range(len(l))) AS pos, unnest(l) AS val
      FROM (SELECT {listed}, {sql} AS l FROM {view}))"""

    def run(t: Tables) -> DataFrame:
        rows = t.view(view).select(*keys, F.posexplode(column()).alias("pos", "val"))
        return rows.select(*keys, F.col("pos").cast("long").alias("pos"), r(F.col("val")).alias("val"))

    query(name, body, (view,))(run)


def softmax_sql(arr: str, scale: str = "1e0") -> str:
    ex = f"[exp(({{}} - list_max({arr})) * {scale}) for {{}} in {arr}]"
    inner = ex.format("q", "q")
    return f"[exp((p - list_max({arr})) * {scale}) / list_sum({inner}) for p in {arr}]"


array_query("p28_softmax", lambda: R.softmax(F.col("logits"), 0.25), softmax_sql("logits", "0.25e0"))
array_query(
    "p29_group_softmax", lambda: R.group_softmax(F.col("logits"), [8, 4, 20]),
    f"{softmax_sql('logits[1:8]')} || {softmax_sql('logits[9:12]')} || {softmax_sql('logits[13:32]')}",
)


@query(
    "p30_argmax",
    f"SELECT vec_id, list_position(logits, list_max(logits)) - 1 AS at, {rs('list_max(logits)')} AS top FROM v_logits",
    ("v_logits",),
)
def _(t: Tables) -> DataFrame:
    return t.v_logits.select(
        "vec_id", R.argmax(F.col("logits")).alias("at"), r(R.max_score(F.col("logits"))).alias("top")
    )


array_query(
    "p31_sigmoid", lambda: F.transform("logits", lambda x: R.sigmoid(x * 10)),
    "[1 / (1 + exp(-10 * logits[i])) for i in range(1, 33)]",
)
_PA, _PB = softmax_sql("logits"), softmax_sql("other")
array_query(
    "p32_fuse_prob",
    lambda: R.fuse_prob(R.softmax(F.col("logits")), R.softmax(F.col("other"))),
    "[exp(logits[i] + other[i]) / list_sum([exp(logits[j] + other[j]) for j in range(1, 33)]) for i in range(1, 33)]",
)
array_query(
    "p33_one_vs_rest",
    lambda: R.one_vs_rest(F.col("label"), F.abs(F.get("logits", F.lit(0))), 10),
    "[CASE WHEN i = label THEN abs(logits[1]) ELSE (1 - abs(logits[1])) / 9 END for i in range(0, 10)]",
)
array_query(
    "p34_fuse_heatmaps", lambda: R.fuse_heatmaps(F.col("logits"), F.col("other")),
    "[logits[i] + 0.056256e0 / (1 - 0.056256e0 - 0.876241e0) * other[i] + 0.876241e0 / "
    "(1 - 0.056256e0 - 0.876241e0) * logits[i] * other[i] for i in range(1, 33)]",
)
array_query(
    "p37_l2_normalize", lambda: R.l2_normalize(F.col("logits"), 1e-10, 20.0),
    "[20 * p / sqrt(list_sum([q * q for q in logits]) + 1e-10) for p in logits]",
)
array_query(
    "p39_rescale_pixels",
    # 32 values and the first again are 11 pixels
    lambda: R.channel_major(R.rescale(F.concat("logits", F.slice("logits", 1, 1))), 3, True),
    "[2e0 / 255 * (logits || logits[1:1])[i * 3 + 3] - 1 for i in range(0, 11)] || "
    "[2e0 / 255 * (logits || logits[1:1])[i * 3 + 2] - 1 for i in range(0, 11)] || "
    "[2e0 / 255 * (logits || logits[1:1])[i * 3 + 1] - 1 for i in range(0, 11)]",
)
array_query(
    "k4_topk_indices", lambda: R.topk_indices(F.col("logits"), 5),
    "[CAST(s.i AS DOUBLE) for s in list_sort([{'v': -logits[i], 'i': i - 1} for i in range(1, 33)])[1:5]]",
)
array_query(
    "u2_concat_levels", lambda: R.concat_arrays(F.col("logits"), F.reverse("other"), F.col("scores")),
    "logits || list_reverse(other) || scores",
)


@query(
    "u3_split_array",
    f"""SELECT vec_id, copy, piece, {rs('list_sum(part)')} AS total, len(part) AS n FROM (
      SELECT vec_id, copy, unnest(['a', 'b', 'c']) AS piece,
        unnest([logits[1:4], logits[5:16], logits[17:32]]) AS part
      FROM v_logits, (VALUES (0), (1)) c(copy))""",
    ("v_logits",),
)
def _(t: Tables) -> DataFrame:
    from framewise.operators.aggregate import tile

    parts = R.split_array(F.col("logits"), [4, 12, 16])
    named = F.array(*(F.struct(F.lit(n).alias("piece"), p.alias("part")) for n, p in zip("abc", parts)))
    rows = tile(t.v_logits, 2).select("vec_id", "copy", F.explode(named).alias("s"))
    return rows.select(
        "vec_id", "copy", "s.piece", r(R.array_sum(F.col("s.part"))).alias("total"),
        F.size("s.part").cast("long").alias("n"),
    )


# ------------------------------------------------------------ tensors and bytes
project(
    "p40_range_to_byte", "v_events", ("event_id",),
    lambda: {"byte": R.to_byte(F.col("value") * 100 + 26800)},
    {"byte": "greatest(least(round_even((value * 100 + 26800 - 27315e0) * (255e0 / 6000e0), 0), 255e0), 0e0)"},
)
_AMAX = "CASE WHEN iteration % 50 = 0 THEN 0e0 ELSE 0.25e0 END"


def _amax():
    return F.when(F.col("iteration") % 50 == 0, F.lit(0.0)).otherwise(F.lit(0.25))


def _code(top: str, low: str) -> str:
    return (
        f"CASE WHEN {_AMAX} = 0 THEN 0e0 ELSE greatest(least(round_even(val * ({top} / nullif({_AMAX}, 0e0)), 0), {top}), {low}) END"
    )


def _safe_amax():
    return F.nullif(_amax(), F.lit(0.0))


_TK = ("iteration", "output", "idx")
project(
    "p41_quantize", "v_tensor", _TK,
    lambda: {
        "q": R.quantize(F.col("val"), _amax()),
        "q_wide": R.quantize(F.col("val"), _amax(), narrow=False),
        "q4": R.quantize(F.col("val"), _amax(), bits=4),
        "uq": R.quantize(F.abs(F.col("val")), _amax(), unsigned=True),
    },
    {
        "q": _code("127e0", "-127e0"), "q_wide": _code("127e0", "-128e0"), "q4": _code("7e0", "-7e0"),
        "uq": _code("255e0", "0e0").replace("val", "abs(val)"),
    },
)
project(
    "p42_fake_quantize", "v_tensor", _TK, lambda: {"fq": R.fake_quantize(F.col("val"), _amax())},
    {"fq": f"({_code('127e0', '-127e0')}) / CASE WHEN {_AMAX} = 0 THEN 1e0 ELSE 127e0 / nullif({_AMAX}, 0e0) END"},
)
_STEP = "(0.5e0 / 255)"
_ZERO = f"(round_even(-0.2e0 / {_STEP}, 0) + 128)"
project(
    "p43_fake_affine_quantize", "v_tensor", _TK,
    lambda: {"fq": R.fake_affine_quantize(F.col("val"), F.lit(-0.2), F.lit(0.3))},
    {"fq": f"(greatest(least(round_even(val / {_STEP}, 0) - {_ZERO}, 127e0), -128e0) + {_ZERO}) * {_STEP}"},
)


@query(
    "p38_standardize",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, {rs('(l_quantity - m) / sqrt(v + 1e-5)')} AS z
    FROM lineitem JOIN (SELECT l_suppkey, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1)
    USING (l_suppkey)""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity")
    out = standardize(rows, ["l_suppkey"], "l_quantity")
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", r(F.col("standardized")).alias("z"))


# ------------------------------------------------------------------- skeletons
KAPPA_SQL = "[" + ", ".join(f"{k}e0" for k in S.KAPPAS_17) + "]"


@query(
    "p35_oks",
    f"""WITH area AS (SELECT person, (max(x) - min(x)) * (max(y) - min(y)) AS a FROM v_kp GROUP BY 1),
    terms AS (SELECT person, CASE WHEN conf > 0 AND conf2 > 0 THEN
      exp(-(power(x - x2, 2) + power(y - y2, 2)) / (2 * a * {KAPPA_SQL}[kp_idx + 1])) END AS e
      FROM v_kp JOIN area USING (person) WHERE a > 0)
    SELECT area.person, {rs('CASE WHEN max(a) <= 0 THEN 1e0 ELSE coalesce(avg(e), 0e0) END')} AS oks
    FROM area LEFT JOIN terms ON terms.person = area.person GROUP BY 1""",
    ("v_kp",),
)
def _(t: Tables) -> DataFrame:
    xs, ys = F.transform("kps", lambda k: k["x"]), F.transform("kps", lambda k: k["y"])
    area = (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))
    return t.persons.select("person", r(S.oks(F.col("kps"), F.col("kps2"), area)).alias("oks"))


project(
    "p36_depth_sigma", "v_kp", ("person", "kp_idx"),
    lambda: {"sigma": S.depth_sigma(F.col("conf") * 3, F.col("cov_xx"))},
    {"sigma": "0.6e0 / (1 + exp(-20 * (0.65e0 - least(conf * 3, conf * 3 / cov_xx)))) + 0.15e0"},
)
_FIELDS = ("x", "y", "conf", "cov_xx", "cov_xy", "cov_yy")


def _mid_sql(slot: int, a: int, b: int) -> str:
    def pick(c: str) -> str:
        return f"(max(CASE WHEN kp_idx = {a} THEN {c} END) + max(CASE WHEN kp_idx = {b} THEN {c} END)) / 2"

    both = f"max(CASE WHEN kp_idx = {a} THEN conf END) > 0 AND max(CASE WHEN kp_idx = {b} THEN conf END) > 0"
    cols = ", ".join(f"{rs(f'CASE WHEN {both} THEN {pick(c)} ELSE 0e0 END')} AS {c}" for c in _FIELDS)
    return f"SELECT person, {slot} AS kp_idx, {cols} FROM v_kp GROUP BY person HAVING count(*) = 17"


@query(
    "p44_midpoint_joints",
    f"""SELECT person, CAST(kp_idx AS BIGINT) AS kp_idx, {', '.join(f'{rs(c)} AS {c}' for c in _FIELDS)} FROM v_kp
      WHERE kp_idx NOT IN (1, 2) AND person IN (SELECT person FROM v_kp GROUP BY 1 HAVING count(*) = 17)
    UNION ALL {_mid_sql(1, 5, 6)} UNION ALL {_mid_sql(2, 11, 12)}""",
    ("v_kp",),
)
def _(t: Tables) -> DataFrame:
    rows = t.persons.filter(F.size("kps") == 17)
    out = rows.select("person", F.posexplode(S.midpoint_joints(F.col("kps"))).alias("kp_idx", "k"))
    return out.select("person", F.col("kp_idx").cast("long").alias("kp_idx"), *(r(F.col(f"k.{c}")).alias(c) for c in _FIELDS))


_ORDER = (0, 2, 5, 6, 7, 8, -1, 16)


@query(
    "p45_remap_joints",
    f"""SELECT p.person, o.slot, {rs('CASE WHEN conf > 0 THEN x ELSE 0e0 END')} AS x,
      {rs('CASE WHEN conf > 0 THEN y ELSE 0e0 END')} AS y, coalesce(conf > 0, false) AS visible
    FROM (SELECT DISTINCT person FROM v_kp) p
    CROSS JOIN (VALUES {', '.join(f'(CAST({i} AS BIGINT), {k})' for i, k in enumerate(_ORDER))}) o(slot, kp)
    LEFT JOIN v_kp k ON k.person = p.person AND k.kp_idx = o.kp""",
    ("v_kp",),
)
def _(t: Tables) -> DataFrame:
    out = t.persons.select("person", F.posexplode(S.remap_joints(F.col("kps"), _ORDER)).alias("slot", "k"))
    return out.select(
        "person", F.col("slot").cast("long").alias("slot"), r(F.col("k.x")).alias("x"),
        r(F.col("k.y")).alias("y"), "k.visible",
    )


@query(
    "p46_map_label",
    """SELECT frame, det_id, coalesce(CAST(s.s_nationkey AS BIGINT), -1) AS mapped FROM v_det
    LEFT JOIN supplier s ON s.s_suppkey = v_det.label AND s.s_suppkey < 10""",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    dim = t.supplier.filter("s_suppkey < 10").select(
        F.col("s_suppkey").alias("label"), F.col("s_nationkey").cast("long").alias("mapped")
    )
    return map_label(t.v_det, dim).select("frame", "det_id", "mapped")


# --------------------------------------------------------------------- filters
@query(
    "f1_score_filter",
    """SELECT frame, det_id, score > 0.5e0 AS strict FROM v_det WHERE score >= 0.5e0""", ("v_det",),
)
def _(t: Tables) -> DataFrame:
    loose = flt.score_filter(t.v_det, 0.5)
    return loose.select("frame", "det_id", (F.col("score") > 0.5).alias("strict"))


@query("f2_depth_valid", "SELECT frame, pt_id, d FROM v_depth WHERE d > 300 AND d < 12000", ("v_depth",))
def _(t: Tables) -> DataFrame:
    return flt.depth_valid(t.v_depth).select("frame", "pt_id", "d")


@query(
    "f3_in_cube",
    "SELECT frame, pt_id FROM v_pts WHERE x >= -2 AND x < 2 AND y >= -2 AND y < 2 AND z >= -2 AND z < 2",
    ("v_pts",),
)
def _(t: Tables) -> DataFrame:
    return flt.in_cube(t.v_pts, 4.0).select("frame", "pt_id")


@query("f4_in_image", "SELECT frame, pt_id, u, v FROM v_depth WHERE u <= 639 AND v <= 359", ("v_depth",))
def _(t: Tables) -> DataFrame:
    return flt.in_image(t.v_depth, 640, 360).select("frame", "pt_id", "u", "v")


@query("f5_drop_background", "SELECT frame, det_id, label FROM v_det WHERE label <> 0", ("v_det",))
def _(t: Tables) -> DataFrame:
    return flt.drop_label(t.v_det, 0).select("frame", "det_id", "label")


_PERSON_SQL = """p AS (SELECT person, count(*) FILTER (conf > 0) AS n_valid,
   count(*) FILTER (hidden) AS n_occluded, coalesce(avg(conf) FILTER (conf > 0), 0e0) AS conf FROM v_kp GROUP BY 1)"""


def person_table(t: Tables) -> DataFrame:
    return t.v_kp.groupBy("person").agg(
        F.count_if(F.col("conf") > 0).alias("n_valid"), F.count_if("hidden").alias("n_occluded"),
        F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(0.0)).alias("conf"),
    )


@query(
    "f6_valid_person",
    f"""WITH {_PERSON_SQL} SELECT person, n_valid, n_occluded, {rs('conf')} AS conf, n_valid - n_occluded > 0 AS publishable
    FROM p WHERE n_valid > 0 AND (conf > 0.11e0 OR n_occluded > 2)""",
    ("v_kp",),
)
def _(t: Tables) -> DataFrame:
    # fewer than three hidden joints do not count here
    rows = person_table(t)
    weak = rows.withColumn("n_occluded", F.when(F.col("n_occluded") > 2, F.col("n_occluded")).otherwise(0))
    kept = flt.valid_person(weak, 0.11).select("person")
    out = rows.join(kept, "person").select("person", "n_valid", "n_occluded", r(F.col("conf")).alias("conf"))
    return out.withColumn("publishable", F.col("n_valid") - F.col("n_occluded") > 0)


@query(
    "f7_finite_check",
    """WITH w AS (SELECT iteration, output, CASE WHEN idx = iteration % 64 AND iteration % 9 = 0 THEN 'NaN'::DOUBLE
      WHEN idx = iteration % 64 AND iteration % 11 = 0 THEN '-inf'::DOUBLE ELSE val END AS val FROM v_tensor)
    SELECT iteration, output, count(*) FILTER (isnan(val)) AS n_nan, count(*) FILTER (isinf(val)) AS n_inf,
      count(*) FILTER (isnan(val) OR isinf(val)) = 0 AS ok FROM w GROUP BY 1, 2""",
    ("v_tensor",),
)
def _(t: Tables) -> DataFrame:
    hit = F.col("idx") == F.col("iteration") % 64
    val = (
        F.when(hit & (F.col("iteration") % 9 == 0), F.lit(float("nan")))
        .when(hit & (F.col("iteration") % 11 == 0), F.lit(float("-inf")))
        .otherwise(F.col("val"))
    )
    return flt.validate(t.v_tensor.withColumn("val", val), ["iteration", "output"])


@query(
    "f9_coerce_schema",
    f"SELECT vec_id AS iteration, CAST(label AS BIGINT) AS id, len(embedding) AS n, {rs('list_sum([e::DOUBLE for e in embedding])')} AS total FROM embeddings",
)
def _(t: Tables) -> DataFrame:
    from pyspark.sql.types import StructType

    # vec_id and embedding go by position, label by name
    want = StructType.fromDDL("iteration bigint, vals array<double>, label bigint")
    rows = flt.coerce_schema(t.embeddings, want, {"vals": 64})
    return rows.select(
        "iteration", F.col("label").alias("id"), F.size("vals").cast("long").alias("n"),
        r(R.array_sum(F.col("vals"))).alias("total"),
    )


@query(
    "u1_union_detections",
    f"""SELECT frame, det_id, kind, {rs('score')} AS score FROM (
      SELECT frame, det_id, 'object' AS kind, score FROM v_det WHERE label <> 1
      UNION ALL SELECT frame, det_id, 'person', least(score, 0.99e0) FROM v_det WHERE label = 1)""",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    from framewise.operators.suppress import union_detections

    det = t.v_det
    out = union_detections(
        det.filter("label <> 1").withColumn("kind", F.lit("object")),
        det.filter("label = 1").withColumn("kind", F.lit("person")),
    )
    return out.select("frame", "det_id", "kind", r(F.col("score")).alias("score"))


__all__ = ["array_query", "calibrated", "cameras", "join_dim", "moves", "person_table", "softmax_sql"]
