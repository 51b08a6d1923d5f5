"""Joins, suppression and association."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.boxes import Box
from framewise.functions.skeletons import KAPPAS_17, oks, skeleton_box
from framewise.operators import assign as asg
from framewise.operators import spatial, suppress
from framewise.operators import timeline as tl
from framewise.operators.aggregate import keep_topk, topk
from framewise.plans import detection
from framewise.plans.catalog.boxes import PRIORS_SQL, RPN_SQL, proposals, with_priors
from framewise.plans.registry import query, r, rs
from framewise.plans.views import Tables

BOX = list(Box._fields)


def rounded_box() -> list:
    return [r(F.col(c)).alias(c) for c in BOX]


BOX_SQL = ", ".join(f"{rs(c)} AS {c}" for c in BOX)


# ----------------------------------------------------------------- joins by time
def topic(t: Tables, name: str, prefix: str) -> DataFrame:
    return t.v_events.filter(F.col("topic") == name).select(
        "camera", "ts", *(F.col(c).alias(f"{prefix}_{c}") for c in ("event_id", "value"))
    )


def hourly(t: Tables, name: str, prefix: str) -> DataFrame:
    """Latest row of a topic per camera and hour, stamped with the hour."""
    rows = topic(t, name, prefix).withColumn("hour", F.date_trunc("hour", "ts"))
    last = rows.groupBy("camera", "hour").agg(
        F.max_by(f"{prefix}_event_id", F.struct("ts", f"{prefix}_event_id")).alias(f"{prefix}_id"),
        F.max_by(f"{prefix}_value", F.struct("ts", f"{prefix}_event_id")).alias(f"{prefix}_value"),
    )
    return last.withColumnRenamed("hour", "ts")


def _hourly_sql(name: str, p: str) -> str:
    key = "ts + to_microseconds(0)"
    return (
        f"{p} AS (SELECT camera, date_trunc('hour', ts) AS h, arg_max(event_id, (epoch_us({key}), event_id)) AS {p}_id, "
        f"arg_max(value, (epoch_us({key}), event_id)) AS {p}_value FROM v_events WHERE topic = '{name}' GROUP BY 1, 2)"
    )


@query(
    "j1_sync_exact",
    f"""WITH {_hourly_sql('click', 'c')}, {_hourly_sql('view', 'd')}, {_hourly_sql('signup', 'f')}
    SELECT c.camera, epoch_us(c.h) AS us, c_id, {rs('c_value')} AS c_value, d_id, f_id
    FROM c JOIN d USING (camera, h) JOIN f USING (camera, h)""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    parts = [hourly(t, n, p) for n, p in (("click", "c"), ("view", "d"), ("signup", "f"))]
    out = tl.sync_exact(parts, "camera", "ts")
    return out.select("camera", tl.micros("ts").alias("us"), "c_id", r(F.col("c_value")).alias("c_value"), "d_id", "f_id")


def _asof_sql(extra: str, shift: str = "") -> str:
    return f"""WITH a AS (SELECT * FROM v_events WHERE topic = 'click'),
    b AS (SELECT *, us{shift} AS at FROM v_events WHERE topic = 'view'),
    j AS (SELECT a.event_id, a.us, b.event_id AS b_event_id, b.value AS b_value, (a.us - b.us) / 1e6 AS age,
      row_number() OVER (PARTITION BY a.event_id ORDER BY b.us DESC, b.event_id DESC) AS k
      FROM a LEFT JOIN b ON a.camera = b.camera AND b.at <= a.us)
    SELECT event_id, {extra} FROM j WHERE k = 1"""


def _asof(t: Tables, **options) -> DataFrame:
    a = t.v_events.filter("topic = 'click'").select("camera", "ts", "event_id")
    b = t.v_events.filter("topic = 'view'").select("camera", "ts", "event_id", "value")
    out = tl.asof(a, b, "camera", "ts", ["event_id", "value"], tie="event_id", **options)
    return out.select(
        "event_id", "b_event_id", r(F.col("b_value")).alias("b_value"), r(F.col("b_age")).alias("age")
    )


def _asof_cols(ok: str) -> str:
    return (
        f"CASE WHEN {ok} THEN b_event_id END AS b_event_id, {rs(f'CASE WHEN {ok} THEN b_value END')} AS b_value, "
        f"{rs(f'CASE WHEN {ok} THEN age END')} AS age"
    )


@query("j2_asof_latest", _asof_sql(_asof_cols("true")), ("v_events",))
def _(t: Tables) -> DataFrame:
    return _asof(t)


@query("j3_asof_fresh", _asof_sql(_asof_cols("age >= 0 AND age < 3600")), ("v_events",))
def _(t: Tables) -> DataFrame:
    return _asof(t, max_age=3600.0)


@query("j4_asof_one_sided", _asof_sql(_asof_cols("true"), " - 1800000000"), ("v_events",))
def _(t: Tables) -> DataFrame:
    # half an hour ahead is still good, any age is
    return _asof(t, max_lead=1800.0)


# ---------------------------------------------------------------- points and boxes
_IN = "u > xmin AND u < xmax AND v > ymin AND v < ymax"


@query(
    "j5_points_in_box",
    f"SELECT p.frame, pt_id, det_id FROM v_uv p JOIN v_det d ON p.frame = d.frame AND {_IN}",
    ("v_uv", "v_det"),
)
def _(t: Tables) -> DataFrame:
    return spatial.points_in_box(t.v_uv, t.v_det, ["frame"]).select("frame", "pt_id", "det_id")


@query(
    "j6_first_box",
    f"""SELECT p.frame, pt_id, min(det_id) AS det_id FROM v_uv p JOIN v_det d ON p.frame = d.frame AND {_IN}
    GROUP BY 1, 2""",
    ("v_uv", "v_det"),
)
def _(t: Tables) -> DataFrame:
    out = spatial.first_box(t.v_uv, t.v_det, ["frame"], "pt_id", "det_id")
    return out.select("frame", "pt_id", "det_id")


@query(
    "j7_best_box",
    f"""WITH RECURSIVE pairs AS (SELECT p.frame, p.pt_id, d.det_id, label, xmin, ymin, xmax, ymax,
        row_number() OVER (PARTITION BY p.frame, p.pt_id ORDER BY d.det_id) AS k
      FROM v_uv p JOIN v_det d ON p.frame = d.frame AND {_IN}),
    scan AS (SELECT frame, pt_id, k, det_id, label, xmin, ymin, xmax, ymax FROM pairs WHERE k = 1
      UNION ALL SELECT s.frame, s.pt_id, n.k,
        CASE WHEN take THEN n.det_id ELSE s.det_id END, CASE WHEN take THEN n.label ELSE s.label END,
        CASE WHEN take THEN n.xmin ELSE s.xmin END, CASE WHEN take THEN n.ymin ELSE s.ymin END,
        CASE WHEN take THEN n.xmax ELSE s.xmax END, CASE WHEN take THEN n.ymax ELSE s.ymax END
      FROM scan s JOIN pairs n ON n.frame = s.frame AND n.pt_id = s.pt_id AND n.k = s.k + 1,
      LATERAL (SELECT s.label <> 1 AND (n.label = 1 OR (n.label <> s.label
        AND (n.xmax - n.xmin) * (n.ymax - n.ymin) < (s.xmax - s.xmin) * (s.ymax - s.ymin)
        AND greatest(least(n.xmax, s.xmax) - greatest(n.xmin, s.xmin), 0e0) * greatest(least(n.ymax, s.ymax)
          - greatest(n.ymin, s.ymin), 0e0) / ((n.xmax - n.xmin) * (n.ymax - n.ymin) + 2.220446049250313e-16) > 0.5e0)) AS take) x)
    SELECT frame, pt_id, arg_max(det_id, k) AS det_id FROM scan GROUP BY 1, 2""",
    ("v_uv", "v_det"),
)
def _(t: Tables) -> DataFrame:
    out = spatial.best_box(t.v_uv, t.v_det, ["frame"], "pt_id", "det_id", F.col("label") == 1)
    return out.select("frame", "pt_id", "det_id")


# ---------------------------------------------------------------------- grids
def heat_cells(t: Tables) -> DataFrame:
    cells = t.v_heat.select("crop", "kp_idx", F.posexplode("hm").alias("i", "val"))
    return cells.select(
        "crop", "kp_idx", (F.col("i") % 8).cast("long").alias("gu"),
        F.floor(F.col("i") / 8).alias("gv"), "val",
    )


CELLS_SQL = """cells AS (SELECT crop, kp_idx, i % 8 AS gu, i // 8 AS gv, val FROM (
    SELECT crop, kp_idx, unnest(range(64)) AS i, unnest(hm) AS val FROM v_heat))"""
# where the keypoints of a person fall on the maps of the crop of the same number
SPOTS_SQL = """spots AS (SELECT person AS crop, kp_idx, least(greatest(3.5e0 + x / 12, 0e0), 7e0) AS u,
    least(greatest(3.5e0 + y / 12, 0e0), 7e0) AS v FROM v_kp)"""


def spots(t: Tables) -> DataFrame:
    def fit(c: str):
        return F.least(F.greatest(F.col(c) / 12 + 3.5, F.lit(0.0)), F.lit(7.0))

    return t.v_kp.select(F.col("person").alias("crop"), "kp_idx", fit("x").alias("u"), fit("y").alias("v"))


@query(
    "j8_bilinear_lookup",
    f"""WITH {CELLS_SQL}, {SPOTS_SQL} SELECT crop, kp_idx, {rs('sum(w * val)')} AS val FROM (
      SELECT s.crop, s.kp_idx, c.val, (CASE WHEN c.gu = floor(u) THEN ceil(u) - u ELSE 0e0 END +
        CASE WHEN c.gu = ceil(u) THEN 1 - (ceil(u) - u) ELSE 0e0 END) * (CASE WHEN c.gv = floor(v) THEN ceil(v) - v ELSE 0e0 END +
        CASE WHEN c.gv = ceil(v) THEN 1 - (ceil(v) - v) ELSE 0e0 END) AS w
      FROM spots s JOIN cells c ON c.crop = s.crop AND c.kp_idx = s.kp_idx AND c.gu IN (floor(u), ceil(u)) AND c.gv IN (floor(v), ceil(v)))
    GROUP BY 1, 2""",
    ("v_heat", "v_kp"),
)
def _(t: Tables) -> DataFrame:
    out = spatial.bilinear(spots(t), heat_cells(t), ["crop", "kp_idx"], [])
    return out.select("crop", "kp_idx", r(F.col("val")).alias("val"))


@query(
    "j9_neighbourhood",
    f"""WITH {CELLS_SQL}, {SPOTS_SQL} SELECT s.crop, s.kp_idx, gu, gv, {rs('val')} AS val FROM spots s
    JOIN cells c ON c.crop = s.crop AND c.kp_idx = s.kp_idx AND abs(gu - floor(u + 0.5e0)) <= 2 AND abs(gv - floor(v + 0.5e0)) <= 2""",
    ("v_heat", "v_kp"),
)
def _(t: Tables) -> DataFrame:
    out = spatial.neighbourhood(spots(t), heat_cells(t), ["crop", "kp_idx"], [], 2)
    return out.select("crop", "kp_idx", "gu", "gv", r(F.col("val")).alias("val"))


# ---------------------------------------------------------------- suppression
def iou_sql(a: str, b: str, pixel: bool = False) -> str:
    one = " + 1" if pixel else ""
    inter = (
        f"(greatest(least({a}.xmax, {b}.xmax) - greatest({a}.xmin, {b}.xmin){one}, 0e0) * "
        f"greatest(least({a}.ymax, {b}.ymax) - greatest({a}.ymin, {b}.ymin){one}, 0e0))"
    )
    def size(s: str) -> str:
        return f"(({s}.xmax - {s}.xmin{one}) * ({s}.ymax - {s}.ymin{one}))"

    eps = "" if pixel else " + 2.220446049250313e-16"
    return f"{inter} / ({size(a)} + {size(b)} - {inter}{eps})"


def greedy_sql(source: str, keys: str, order: str, test: str, name: str = "kept") -> str:
    """CTEs of a sequential scan: one row per step with the list of boxes kept so far."""
    join = " AND ".join(f"n.{k} = s.{k}" for k in keys.split(", "))
    s_keys = ", ".join(f"s.{k}" for k in keys.split(", "))
    entry = "{'det_id': det_id, 'xmin': xmin, 'ymin': ymin, 'xmax': xmax, 'ymax': ymax}"
    n_entry = "{'det_id': n.det_id, 'xmin': n.xmin, 'ymin': n.ymin, 'xmax': n.xmax, 'ymax': n.ymax}"
    return f"""{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM {source}),
    {name}_scan AS (SELECT {keys}, k, [{entry}] AS kept FROM {name}_ranked WHERE k = 1
      UNION ALL SELECT {s_keys}, n.k, CASE WHEN len([1 for o in s.kept if {test}]) > 0 THEN s.kept
        ELSE list_append(s.kept, {n_entry}) END
      FROM {name}_scan s JOIN {name}_ranked n ON {join} AND n.k = s.k + 1),
    {name} AS (SELECT {keys}, unnest(arg_max(kept, k)).det_id AS det_id FROM {name}_scan GROUP BY {keys})"""


_DET_NMS = greedy_sql("v_det", "frame, label", "score DESC, det_id", f"{iou_sql('o', 'n')} > 0.3e0")
_FRAME_NMS = greedy_sql("v_det", "frame", "score DESC, det_id", f"{iou_sql('o', 'n')} > 0.3e0")


@query("a8_nms", f"WITH RECURSIVE {_FRAME_NMS} SELECT frame, det_id FROM kept", ("v_det",))
def _(t: Tables) -> DataFrame:
    return suppress.nms(t.v_det, ["frame"], 0.3).select("frame", "det_id")


@query("a8_nms_per_class", f"WITH RECURSIVE {_DET_NMS} SELECT frame, label, det_id FROM kept", ("v_det",))
def _(t: Tables) -> DataFrame:
    return suppress.nms(t.v_det, ["frame", "label"], 0.3).select("frame", "label", "det_id")


@query(
    "a8_nms_pixel",
    "WITH RECURSIVE "
    + greedy_sql("v_det", "frame", "score DESC, det_id", f"{iou_sql('o', 'n', True)} > 0.5e0")
    + " SELECT frame, det_id FROM kept",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    return suppress.nms(t.v_det, ["frame"], 0.5, iou="pixel").select("frame", "det_id")


_SELF = (
    "(greatest(least(o.xmax, n.xmax) - greatest(o.xmin, n.xmin) + 1, 0e0) * greatest(least(o.ymax, n.ymax) "
    "- greatest(o.ymin, n.ymin) + 1, 0e0)) / ((n.xmax - n.xmin + 1) * (n.ymax - n.ymin + 1)) > 0.4e0"
)


@query(
    "a9_nms_bottom",
    f"WITH RECURSIVE {greedy_sql('v_det', 'frame', 'ymax DESC, det_id DESC', _SELF)} SELECT frame, det_id FROM kept",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    return suppress.nms_bottom(t.v_det, ["frame"], 0.4).select("frame", "det_id")


@query(
    "a10_nms_persons",
    f"""WITH RECURSIVE {greedy_sql('v_det', 'frame', 'score DESC, det_id', f"{iou_sql('o', 'n')} > 0.4e0")},
    i AS (SELECT d.*, k.k FROM kept_ranked k JOIN kept USING (frame, det_id) JOIN v_det d USING (frame, det_id)),
    j AS (SELECT d.*, k.k FROM kept_ranked k JOIN v_det d USING (frame, det_id)),
    gone AS (SELECT j.frame, j.det_id, min(i.k) AS by_k FROM j JOIN i ON i.frame = j.frame AND i.k < j.k AND {iou_sql('i', 'j')} > 0.4e0
      WHERE (j.frame, j.det_id) NOT IN (SELECT (frame, det_id) FROM kept) GROUP BY 1, 2),
    touch AS (SELECT i.frame, CASE WHEN (i.xmax - i.xmin) * (i.ymax - i.ymin) < (j.xmax - j.xmin) * (j.ymax - j.ymin)
        THEN i.det_id ELSE j.det_id END AS det_id
      FROM i JOIN j ON i.frame = j.frame AND i.k < j.k AND {iou_sql('i', 'j')} > 0.03e0 AND {iou_sql('i', 'j')} <= 0.4e0
      LEFT JOIN gone g ON g.frame = j.frame AND g.det_id = j.det_id WHERE g.by_k IS NULL OR g.by_k >= i.k)
    SELECT frame, det_id, (frame, det_id) NOT IN (SELECT (frame, det_id) FROM touch) AS estimate_depth FROM kept""",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    out = suppress.nms_persons(t.v_det, ["frame"], 0.4, 0.03, "score", "det_id")
    return out.select("frame", "det_id", "estimate_depth")


@query(
    "j10_append_if_no_overlap",
    f"""WITH RECURSIVE a AS (SELECT * FROM v_det WHERE label < 7),
    free AS (SELECT * FROM v_det n WHERE label >= 7 AND NOT EXISTS (SELECT 1 FROM a o WHERE o.frame = n.frame AND {iou_sql('o', 'n')} > 0.1e0)),
    {greedy_sql('free', 'frame', 'det_id', f"{iou_sql('o', 'n')} > 0.1e0")}
    SELECT frame, det_id FROM a UNION ALL SELECT frame, det_id FROM kept""",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    det = t.v_det
    out = suppress.append_no_overlap(det.filter("label < 7"), det.filter("label >= 7"), ["frame"], 0.1)
    return out.select("frame", "det_id")


# ---------------------------------------------------------------- association
def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    det = t.v_det
    a = det.filter("label < 7").select("frame", F.col("det_id").alias("a_id"), *BOX)
    b = det.filter("label >= 7").select("frame", F.col("det_id").alias("b_id"), *BOX)
    return a, b


# every way to give the a-boxes of a frame, one after the other, a free overlapping b-box or none
_ASSIGN_SQL = f"""WITH RECURSIVE a AS (SELECT * FROM v_det WHERE label < 7), b AS (SELECT * FROM v_det WHERE label >= 7),
    p AS (SELECT *, iou + ((a_id % 1009 * 31 + b_id % 1013 * 17) % 1021) / 1021e0 * 1e-7 AS gain FROM (
      SELECT a.frame, a.det_id AS a_id, b.det_id AS b_id, {iou_sql('a', 'b')} AS iou FROM a JOIN b ON a.frame = b.frame
      AND {iou_sql('a', 'b')} > 0)),
    turn AS (SELECT frame, a_id, row_number() OVER (PARTITION BY frame ORDER BY a_id) AS k FROM (SELECT DISTINCT frame, a_id FROM p)),
    options AS (SELECT frame, k, a_id, b_id, iou, gain FROM turn JOIN p USING (frame, a_id)
      UNION ALL SELECT frame, k, a_id, NULL, 0e0, 0e0 FROM turn),
    state AS (SELECT frame, 0 AS k, []::BIGINT[] AS used, 0e0 AS total, []::STRUCT(a BIGINT, b BIGINT, iou DOUBLE)[] AS chosen
        FROM (SELECT DISTINCT frame FROM turn)
      UNION ALL SELECT s.frame, s.k + 1, CASE WHEN b_id IS NULL THEN used ELSE list_append(used, b_id) END, total + gain,
        CASE WHEN b_id IS NULL THEN chosen ELSE list_append(chosen, {{'a': a_id, 'b': b_id, 'iou': iou}}) END
      FROM state s JOIN options o ON o.frame = s.frame AND o.k = s.k + 1 WHERE b_id IS NULL OR NOT list_contains(used, b_id)),
    done AS (SELECT s.frame, unnest(arg_max(chosen, total)) AS c FROM state s
      JOIN (SELECT frame, max(k) AS n FROM turn GROUP BY 1) m ON m.frame = s.frame AND s.k = m.n GROUP BY s.frame)
    SELECT frame, c.a AS a_id, c.b AS b_id, {rs('c.iou')} AS iou FROM done WHERE c.iou > 0.2e0"""


@query("j11_assign_one_to_one", _ASSIGN_SQL, ("v_det",))
def _(t: Tables) -> DataFrame:
    a, b = _sides(t)
    def tie(x, y):
        return (x % 1009 * 31 + y % 1013 * 17) % 1021 / 1021.0

    out = asg.assign(a, b, ["frame"], min_iou=0.2, tie=tie)
    return out.select("frame", "a_id", "b_id", r(F.col("iou")).alias("iou"))


def tracks(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Persons of all crops by frame (three persons each), and the tracks of the frame before."""
    rows = t.persons.withColumn("frame", F.floor(F.col("person") / 3))
    cur = rows.select(
        "frame", "person", "kps", skeleton_box(F.col("kps")).alias("_b")
    ).select("frame", "person", "kps", "_b.*")
    prev = rows.select(
        "frame", (F.col("person") + 1000).alias("track"), F.col("kps2").alias("kps"),
        (F.col("person") % 7).cast("int").alias("num_obs"),
        F.size(F.filter("kps2", lambda k: k["conf"] > 0)).alias("n_parts"),
        skeleton_box(F.col("kps2")).alias("_b"),
    ).select("frame", "track", "kps", "num_obs", "n_parts", "_b.*")
    return cur, prev


def _similar(p, q):
    area = (p["xmax"] - p["xmin"]) * (p["ymax"] - p["ymin"])
    return oks(p["kps"], q["kps"], area)


KAPPA_SQL = "[" + ", ".join(f"{k}e0" for k in KAPPAS_17) + "]"
# as for one-to-one pairing: every way to give the persons of a frame a free track or none
_TRACKS_SQL = f"""WITH RECURSIVE a AS (SELECT person // 3 AS frame, person, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax
      FROM v_kp WHERE conf > 0 GROUP BY 1, 2),
    b AS (SELECT person // 3 AS frame, person + 1000 AS track, min(x2) FILTER (conf2 > 0) AS xmin, max(x2) FILTER (conf2 > 0) AS xmax,
      min(y2) FILTER (conf2 > 0) AS ymin, max(y2) FILTER (conf2 > 0) AS ymax, count(*) FILTER (conf2 > 0) AS n_parts,
      CAST(person % 7 AS INTEGER) AS num_obs FROM v_kp GROUP BY 1, 2, person),
    same AS (SELECT a.person, b.track, avg(exp(-((k.x - q.x2) * (k.x - q.x2) + (k.y - q.y2) * (k.y - q.y2))
        / ((a.xmax - a.xmin) * (a.ymax - a.ymin) * 2 * {KAPPA_SQL}[k.kp_idx + 1]))) AS oks
      FROM a JOIN b USING (frame) JOIN v_kp k ON k.person = a.person JOIN v_kp q ON q.person + 1000 = b.track AND q.kp_idx = k.kp_idx
      WHERE k.conf > 0 AND q.conf2 > 0 GROUP BY 1, 2),
    p AS (SELECT * FROM (SELECT a.frame, a.person, b.track, 0.5e0 * ({iou_sql('a', 'b')}) + 0.5e0 * coalesce(oks, 0e0) AS gain
      FROM a JOIN b USING (frame) LEFT JOIN same ON same.person = a.person AND same.track = b.track) WHERE gain > 0),
    turn AS (SELECT frame, person, row_number() OVER (PARTITION BY frame ORDER BY person) AS k FROM (SELECT DISTINCT frame, person FROM p)),
    options AS (SELECT frame, k, person, track, gain FROM turn JOIN p USING (frame, person) UNION ALL SELECT frame, k, person, NULL, 0e0 FROM turn),
    state AS (SELECT frame, 0 AS k, []::BIGINT[] AS used, 0e0 AS total, []::STRUCT(a BIGINT, b BIGINT, g DOUBLE)[] AS chosen
        FROM (SELECT DISTINCT frame FROM turn)
      UNION ALL SELECT s.frame, s.k + 1, CASE WHEN track IS NULL THEN used ELSE list_append(used, track) END, total + gain,
        CASE WHEN track IS NULL THEN chosen ELSE list_append(chosen, {{'a': person, 'b': track, 'g': gain}}) END
      FROM state s JOIN options o ON o.frame = s.frame AND o.k = s.k + 1 WHERE track IS NULL OR NOT list_contains(used, track)),
    done AS (SELECT s.frame, unnest(arg_max(chosen, total)) AS c FROM state s
      JOIN (SELECT frame, max(k) AS n FROM turn GROUP BY 1) m ON m.frame = s.frame AND s.k = m.n GROUP BY s.frame),
    pairs AS (SELECT frame, c.a AS person, c.b AS track FROM done WHERE c.g > 0.25e0),
    whole AS (SELECT DISTINCT person // 3 AS frame, person FROM v_kp)
    SELECT w.frame, w.person, pairs.track, CAST(coalesce(b.num_obs, -1) + 1 AS INTEGER) AS num_obs, false AS placeholder
      FROM whole w LEFT JOIN pairs ON pairs.person = w.person LEFT JOIN b ON b.track = pairs.track
    UNION ALL SELECT frame, NULL, track, num_obs, true FROM b
      WHERE num_obs > 3 AND n_parts > 5 AND track NOT IN (SELECT track FROM pairs)"""


@query("j12_associate_tracks", _TRACKS_SQL, ("v_kp",))
def _(t: Tables) -> DataFrame:
    cur, prev = tracks(t)
    return asg.associate_tracks(cur, prev, ["frame"], _similar)


@query(
    "j13_unmatched_occluded",
    f"""WITH p AS (SELECT person, count(*) FILTER (conf2 > 0) AS n_valid, count(*) FILTER (hidden) AS n_occluded,
      count(*) FILTER (hidden OR conf2 > 0) AS n_hidden FROM v_kp GROUP BY 1)
    SELECT person, n_valid AS n_occluded, 0e0 AS score, n_hidden, 0e0 AS total_conf FROM p
    WHERE person % 3 <> 0 AND n_occluded * 1e0 / nullif(n_valid, 0) > 0.15e0""",
    ("v_kp",),
)
def _(t: Tables) -> DataFrame:
    rows = t.persons.select(
        "person", F.col("kps2").alias("kps"), F.lit(0.5).alias("score"),
        F.size(F.filter("kps2", lambda k: k["conf"] > 0)).cast("long").alias("n_valid"),
        # scaled so that the fixed share of one half falls at 0.15 here
        (F.size(F.filter("kps2", lambda k: k["occluded"])) * (0.5 / 0.15)).alias("n_occluded"),
    )
    matched = rows.filter("person % 3 = 0").select("person")
    out = asg.keep_occluded(rows, matched, [], "person")
    return out.select(
        "person", F.col("n_occluded").cast("long").alias("n_occluded"), "score",
        F.size(F.filter("kps", lambda k: k["occluded"])).cast("long").alias("n_hidden"),
        F.aggregate("kps", F.lit(0.0), lambda acc, k: acc + k["conf"]).alias("total_conf"),
    )


_OCC = {"x": "x2", "y": "y2", "cov_xx": "cov_xx", "conf": "0e0"}


@query(
    "j14_replace_occluded",
    f"""SELECT v.person, CAST(kp_idx AS BIGINT) AS kp_idx,
      {', '.join(f'{rs(f"CASE WHEN hidden THEN {o} ELSE {c} END")} AS {c}' for c, o in _OCC.items())},
      hidden AS occluded, n_valid, n_occluded
    FROM v_kp v JOIN (SELECT person, count(*) FILTER (conf > 0) + count(*) FILTER (hidden AND conf = 0) AS n_valid,
      count(*) FILTER (hidden) AS n_occluded FROM v_kp GROUP BY 1) USING (person)""",
    ("v_kp",),
)
def _(t: Tables) -> DataFrame:
    a = t.persons.select(
        "person", "kps", F.lit(0).cast("long").alias("n_occluded"),
        F.size(F.filter("kps", lambda k: k["conf"] > 0)).cast("long").alias("n_valid"),
    )
    b = t.persons.select("person", F.col("kps2").alias("kps"))
    out = asg.replace_occluded(a, b, ["person"])
    rows = out.select("person", "n_valid", "n_occluded", F.posexplode("kps").alias("kp_idx", "k"))
    return rows.select(
        "person", F.col("kp_idx").cast("long").alias("kp_idx"),
        *(r(F.col(f"k.{c}")).alias(c) for c in _OCC), "k.occluded", "n_valid", "n_occluded",
    )


# ----------------------------------------------------------------- ground truth
GT_IOU = iou_sql("d", "g", False).replace(" + 2.220446049250313e-16", "")
MATCH_SQL = f"""best AS (SELECT d.frame, d.label, d.det_id, g.gt_id, g.difficult, {GT_IOU} AS iou,
      row_number() OVER (PARTITION BY d.frame, d.label, d.det_id ORDER BY {GT_IOU} DESC, g.gt_id) AS k
      FROM v_det d JOIN v_gt g ON d.frame = g.frame AND d.label = g.label),
    good AS (SELECT * FROM best WHERE k = 1 AND iou > 0.5e0),
    turn AS (SELECT d.frame, d.label, d.det_id, d.score, g.gt_id, g.difficult,
      row_number() OVER (PARTITION BY d.frame, d.label, g.gt_id ORDER BY d.score DESC, d.det_id) AS n
      FROM v_det d LEFT JOIN good g ON d.frame = g.frame AND d.label = g.label AND d.det_id = g.det_id),
    matches AS (SELECT frame, label, det_id, score, gt_id,
      CASE WHEN gt_id IS NOT NULL AND NOT difficult AND n = 1 THEN 1 ELSE 0 END AS tp,
      CASE WHEN gt_id IS NULL OR (NOT difficult AND n > 1) THEN 1 ELSE 0 END AS fp FROM turn)"""


def matches(t: Tables) -> DataFrame:
    return spatial.match_truth(t.v_det, t.v_gt, ["frame", "label"], "det_id", "gt_id")


@query(
    "j17_match_truth", f"WITH {MATCH_SQL} SELECT frame, label, det_id, gt_id, tp, fp FROM matches", ("v_det", "v_gt"),
)
def _(t: Tables) -> DataFrame:
    return matches(t).select("frame", "label", "det_id", "gt_id", "tp", "fp")


# ---------------------------------------------------------------------- top-k
@query(
    "k1_topk_per_frame",
    """SELECT frame, person, det_id, rank FROM (SELECT *, label = 1 AS person, row_number() OVER
      (PARTITION BY frame, label = 1 ORDER BY score DESC, det_id DESC) AS rank FROM v_det) WHERE rank <= 3""",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    rows = t.v_det.withColumn("person", F.col("label") == 1)
    out = topk(rows, ["frame", "person"], ["-score", "-det_id"], 3, rank="rank")
    return out.select("frame", "person", "det_id", F.col("rank").cast("long").alias("rank"))


@query(
    "k2_topk_per_class",
    """SELECT frame, label, det_id FROM (SELECT *, row_number() OVER (PARTITION BY frame, label
      ORDER BY score DESC, det_id) AS k FROM v_det) WHERE k <= 1""",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    return topk(t.v_det, ["frame", "label"], ["-score", "det_id"], 1).select("frame", "label", "det_id")


@query(
    "k3_keep_topk",
    f"""WITH top AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_id) AS slot FROM v_det),
    n AS (SELECT frame, least(count(*), 4) AS n_valid FROM v_det GROUP BY 1)
    SELECT n.frame, CAST(s.slot AS BIGINT) AS slot, n.n_valid, coalesce(label, -1) AS label, coalesce(det_id, 0) AS det_id,
      {rs('coalesce(score, 0e0)')} AS score
    FROM n CROSS JOIN (VALUES (1), (2), (3), (4)) s(slot) LEFT JOIN top ON top.frame = n.frame AND top.slot = s.slot""",
    ("v_det",),
)
def _(t: Tables) -> DataFrame:
    out = keep_topk(t.v_det, ["frame"], ["-score", "det_id"], 4, pad=True)
    return out.select(
        "frame", F.col("slot").cast("long").alias("slot"), "n_valid", "label", "det_id", r(F.col("score")).alias("score")
    )


@query(
    "k5_topk_items",
    f"""SELECT user_id, event_id, CAST(rank AS BIGINT) AS rank, {rs('value')} AS value FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM v_events) WHERE rank <= 5""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    out = topk(t.v_events, ["user_id"], ["-value", "event_id"], 5, rank="rank")
    return out.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"), r(F.col("value")).alias("value"))


# -------------------------------------------------------- whole detection chains
_K7 = f"""WITH RECURSIVE strong AS (SELECT * FROM v_det WHERE score >= 0.3e0 AND label <> 0),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, label ORDER BY score DESC, det_id) AS c
      FROM strong) WHERE c <= 100),
    {greedy_sql('first', 'frame, label', 'score DESC, det_id', f"{iou_sql('o', 'n')} > 0.3e0")},
    best AS (SELECT d.*, row_number() OVER (PARTITION BY d.frame ORDER BY d.score DESC, d.det_id) AS slot
      FROM kept JOIN v_det d USING (frame, label, det_id)),
    n AS (SELECT frame, least(count(*), 5) AS n_valid FROM best GROUP BY 1)
    SELECT best.frame, CAST(slot AS BIGINT) AS slot, n_valid, label, det_id, {rs('score')} AS score, {BOX_SQL}
    FROM best JOIN n USING (frame) WHERE slot <= 5"""


@query("k7_best_detections", _K7, ("v_det",))
def _(t: Tables) -> DataFrame:
    out = detection.detect(t.v_det, score_threshold=0.3, background=0, top_k=100, nms_iou=0.3, keep=5)
    return out.select(
        "frame", F.col("slot").cast("long").alias("slot"), "n_valid", "label", "det_id",
        r(F.col("score")).alias("score"), *rounded_box(),
    )


_V = ("0.1e0", "0.1e0", "0.2e0", "0.2e0")
_DEC = (
    "decoded AS (SELECT frame, det_id, label, score, "
    + ", ".join(
        f"greatest(least((0.1e0 * {o} * ({hi} - {lo}) + ({lo} + {hi}) / 2) {s} exp(0.2e0 * {e}) * ({hi} - {lo}) / 2, 1e0), 0e0) AS {n}"
        for n, o, e, s, lo, hi in (
            ("xmin", "o0", "o2", "-", "p.xmin", "p.xmax"), ("ymin", "o1", "o3", "-", "p.ymin", "p.ymax"),
            ("xmax", "o0", "o2", "+", "p.xmin", "p.xmax"), ("ymax", "o1", "o3", "+", "p.ymin", "p.ymax"),
        )
    )
    + " FROM v_offset o JOIN priors p USING (anchor_id))"
)


@query(
    "k7_detect_from_offsets",
    f"""WITH RECURSIVE {PRIORS_SQL}, {_DEC}, strong AS (SELECT * FROM decoded WHERE score > 0.2e0 AND label <> 0),
    {greedy_sql('strong', 'frame, label', 'score DESC, det_id', f"{iou_sql('o', 'n')} > 0.45e0")},
    best AS (SELECT d.*, row_number() OVER (PARTITION BY d.frame ORDER BY d.score DESC, d.det_id) AS slot
      FROM kept JOIN strong d USING (frame, label, det_id))
    SELECT frame, CAST(slot AS BIGINT) AS slot, label, det_id, {rs('score')} AS score, {BOX_SQL} FROM best WHERE slot <= 10""",
    ("v_offset",),
)
def _(t: Tables) -> DataFrame:
    rows = detection.decode(with_priors(t), "center_size", clip=True)
    out = detection.detect(
        rows, score_threshold=0.2, strict=True, background=0, top_k=400, nms_iou=0.45, keep=10
    )
    return out.select(
        "frame", F.col("slot").cast("long").alias("slot"), "label", "det_id", r(F.col("score")).alias("score"),
        *rounded_box(),
    )


@query(
    "k8_propose",
    f"""WITH RECURSIVE {RPN_SQL}, alive AS (SELECT * FROM rpn WHERE score IS NOT NULL),
    levels AS (SELECT *, label % 2 AS level FROM alive),
    {greedy_sql('levels', 'frame, level', 'score DESC, det_id', f"{iou_sql('o', 'n', True)} > 0.7e0")},
    best AS (SELECT d.*, row_number() OVER (PARTITION BY d.frame ORDER BY d.score DESC, d.det_id) AS slot
      FROM kept JOIN levels d USING (frame, level, det_id))
    SELECT frame, CAST(slot AS BIGINT) AS slot, level, det_id, {rs('score')} AS score, {BOX_SQL} FROM best WHERE slot <= 3""",
    ("v_offset",),
)
def _(t: Tables) -> DataFrame:
    rows = proposals(t)
    levels = {n: rows.filter(F.col("label") % 2 == n) for n in (0, 1)}
    out = detection.propose_levels(levels, ["frame"], before=1000, nms_iou=0.7, per_level=1000, keep=3, iou="pixel")
    return out.select(
        "frame", F.col("slot").cast("long").alias("slot"), F.col("level").cast("long").alias("level"), "det_id",
        r(F.col("score")).alias("score"), *rounded_box(),
    )
