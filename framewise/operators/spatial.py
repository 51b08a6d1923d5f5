"""Joins between points, boxes and grid cells of one frame.

All of them are equi joins on (frame, grid cell) with the exact test as residual
predicate, so a frame that holds a large share of all rows spreads over its cells.
Cells have a level per size of box (`grid`): a box is at most four rows. Where all frames are
small, rows need no cells: a frame is one group, compared with itself in place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import boxes as B
from framewise.functions.boxes import Box
from framewise.operators.grid import CELL, MEET, levels_in, meeting, own_cells, probes
from framewise.operators.scale import groups_are_small, join_on, max_group


def points_in_box(
    pts: DataFrame, boxes: DataFrame, on: Sequence[str], cell: float = 64.0,
    u: str = "u", v: str = "v",
) -> DataFrame:
    """Pairs of a point and a box of its frame that strictly contains it.

    A point lies in one cell of the box's level, so each pair comes out once.
    """
    if groups_are_small(on, pts, boxes):
        return _inside(pts.join(boxes, list(on)), u, v)
    left = probes(pts, F.col(u), F.col(v), levels_in(boxes, Box.of(), cell), cell)
    right = own_cells(boxes, Box.of(), cell)
    return _inside(left.join(right, [*on, *CELL]), u, v).drop(*CELL)


def _inside(pairs: DataFrame, u: str, v: str) -> DataFrame:
    x, y = F.col(u), F.col(v)
    b = Box.of()
    return pairs.filter((x > b.xmin) & (x < b.xmax) & (y > b.ymin) & (y < b.ymax))


def first_box(
    pts: DataFrame, boxes: DataFrame, on: Sequence[str], point_id: str, order: str,
    cell: float = 64.0,
) -> DataFrame:
    """For each contained point the first containing box in list ``order``."""
    pairs = points_in_box(pts, boxes, on, cell)
    fields = F.struct(*(F.col(c) for c in boxes.columns if c not in on))
    # min_by is combined before the shuffle
    best = pairs.groupBy(*on, point_id).agg(F.min_by(fields, F.col(order)).alias("_b"))
    return best.select(*on, point_id, "_b.*")


def best_box(
    pts: DataFrame, boxes: DataFrame, on: Sequence[str], point_id: str, order: str,
    person: Column, cell: float = 64.0, inside: float = 0.5, limit: int = 512,
) -> DataFrame:
    """For each contained point the box a scan in list ``order`` ends at.

    The first person box wins. Otherwise the scan starts at the first box and moves
    on to a later one that has another label, is smaller and lies more than
    ``inside`` in the current one. Frames list few boxes, so the scan is a fold over
    the boxes of a point; where some point has more than ``limit`` boxes the scan
    runs as joins, one step of all points at a time.
    """
    key = [*on, point_id]
    # with few boxes to a frame its rows, gathered for the pairs, stay where they are for the scan
    small = groups_are_small(on, pts, boxes, most=limit)
    pairs = _inside(pts.join(boxes, list(on)), "u", "v") if small else points_in_box(pts, boxes, on, cell)
    pairs = pairs.select(
        *key, F.col(order).alias("_o"), F.col("label").alias("_label"), person.alias("_person"),
        *Box.of().columns("_"), F.struct(*(c for c in boxes.columns if c not in on)).alias("_b"),
    )
    thing = F.struct("_o", "_label", *Box.of("_"), "_b")
    if small:
        is_person = F.coalesce("_person", F.lit(False))
        listed = pairs.groupBy(*key).agg(
            F.max(is_person).alias("_any"),
            F.min_by(F.when(is_person, F.col("_b")), F.when(is_person, F.col("_o"))).alias("_first"),
            F.array_sort(F.collect_list(F.when(~is_person, thing))).alias("_l"),
        )
        ended = F.when(F.col("_any"), F.col("_first")).otherwise(_scan(inside, limit))
        return listed.select(*key, ended.alias("_b")).select(*key, "_b.*")
    persons = pairs.filter("_person").groupBy(*key).agg(F.min_by("_b", "_o").alias("_b"))
    things = pairs.join(persons.select(*key), key, "left_anti")
    if max_group(things, key) <= limit:
        listed = things.groupBy(*key).agg(F.array_sort(F.collect_list(thing)).alias("_l"))
        ended = listed.select(*key, _scan(inside, limit).alias("_b"))
    else:
        ended = _scan_by_joins(things, key, inside)
    return persons.unionByName(ended).select(*key, "_b.*")


def _scan(inside: float, limit: int) -> Column:
    """The box a scan over the list ``_l`` ends at."""
    def smaller(cur: Column, new: Column) -> Column:
        a, b = _underscored(new), _underscored(cur)
        return (
            (new["_label"] != cur["_label"])
            & (B.area(a) < B.area(b))
            & (B.overlap_fraction(a, b) > inside)
        )

    return F.aggregate(
        F.slice("_l", 2, limit), F.get("_l", F.lit(0)),
        lambda cur, new: F.when(smaller(cur, new), new).otherwise(cur),
    )["_b"]


def _underscored(s: Column) -> Box:
    return Box(s["_xmin"], s["_ymin"], s["_xmax"], s["_ymax"])


def _scan_by_joins(things: DataFrame, key: Sequence[str], inside: float) -> DataFrame:
    from framewise.session import cut_lineage

    at = F.struct("_o", "_label", *(F.col(f"_{n}") for n in Box._fields), "_b")
    things = cut_lineage(things)
    cur = cut_lineage(things.groupBy(*key).agg(F.min_by(at, "_o").alias("_cur")))
    done = None
    while True:
        steps = things.join(cur, list(key))
        a, b = Box.of("_"), _underscored(F.col("_cur"))
        move = steps.filter(
            (F.col("_o") > F.col("_cur._o"))
            & (F.col("_label") != F.col("_cur._label"))
            & (B.area(a) < B.area(b))
            & (B.overlap_fraction(a, b) > inside)
        )
        moved = cut_lineage(move.groupBy(*key).agg(F.min_by(at, "_o").alias("_cur")))
        stayed = cur.join(moved.select(*key), list(key), "left_anti").select(*key, "_cur._b")
        done = stayed if done is None else done.unionByName(stayed)
        done = cut_lineage(done)
        if moved.isEmpty():
            return done
        cur = moved


def bilinear(
    pts: DataFrame, grid: DataFrame, on: Sequence[str], point_id: Sequence[str], value: str = "val",
    u: str = "u", v: str = "v", by: Sequence[str] = (), whole: bool = False,
) -> DataFrame:
    """Value of a grid (rows ``on, gu, gv, value``) at real coordinates, from four neighbours.

    ``by`` names channels of the grid; each is looked up on its own. With ``whole``, points
    that lack a neighbour, as those outside the grid do, give no row.
    """
    def corners(c: Column) -> Column:
        low, high = F.floor(c), F.ceil(c)
        a = high - c
        return F.array(
            F.struct(low.alias("at"), a.alias("w")), F.struct(high.alias("at"), (1.0 - a).alias("w"))
        )

    spread = (
        pts.withColumn("_cu", F.explode(corners(F.col(u))))
        .withColumn("_cv", F.explode(corners(F.col(v))))
        .select(
            *on, *point_id, F.col("_cu.at").alias("gu"), F.col("_cv.at").alias("gv"),
            (F.col("_cu.w") * F.col("_cv.w")).alias("_w"),
        )
    )
    hit = spread.join(grid.select(*on, "gu", "gv", *by, value), [*on, "gu", "gv"])
    out = hit.groupBy(*on, *point_id, *by).agg(
        F.sum(F.col("_w") * F.col(value)).alias(value), F.count(F.lit(1)).alias("_n")
    )
    return (out.filter("_n = 4") if whole else out).drop("_n")


def neighbourhood(
    pts: DataFrame, grid: DataFrame, on: Sequence[str], point_id: Sequence[str], r: int,
    u: str = "u", v: str = "v",
) -> DataFrame:
    """Grid cells (rows ``on, gu, gv, ...``) within +-r of each rounded location."""
    from framewise.functions.geometry import lround

    def span(c: str) -> Column:
        at = lround(F.col(c))
        return F.explode(F.sequence(at - r, at + r))

    near = pts.select(*on, *point_id, u, v).withColumn("gu", span(u)).withColumn("gv", span(v))
    return near.join(grid, [*on, "gu", "gv"])


def match_truth(
    det: DataFrame, gt: DataFrame, on: Sequence[str], det_id: str, gt_id: str, score: str = "score",
    min_iou: float = 0.5, cell: float = 64.0,
) -> DataFrame:
    """Detections marked ``tp`` / ``fp`` against ground truth of the same ``on`` group.

    Each detection looks at its best-overlapping truth only; the best-scored one
    that reaches it is true, later ones are false, difficult truths do not count.
    Detections without such a truth are false.

    From an IoU of one half on, the overlap covers more than half of each side, so the
    centre of a detection lies in its truth: the detection is looked up as that point.
    Where no group is large, each is matched in place.
    """
    if groups_are_small(on, det, gt):
        return _match_in_place(det, gt, on, det_id, gt_id, score, min_iou)
    left, right = det.select(*on, det_id, *Box.of()), gt.select(*on, gt_id, "difficult", *Box.of().columns("g_"))
    g = Box.of("g_")
    if min_iou >= 0.5:
        middle = [(F.col(f"{a}min") + F.col(f"{a}max")) / 2 for a in "xy"]
        pad = 1e-6
        left, right = probes(left, *middle, levels_in(right, g, cell, pad), cell), own_cells(right, g, cell, pad)
        pairs = left.join(right, [*on, *CELL])
    else:
        left, right = meeting(left, right, Box.of(), g, cell)
        pairs = left.join(right, [*on, *MEET])
    overlap = _iou_exact(Box.of(), Box.of("g_"))
    pairs = pairs.withColumn("iou", overlap).filter(F.col("iou") > min_iou)
    # the first truth wins a tie, so the smaller id
    best = pairs.groupBy(*on, det_id).agg(
        F.max_by(
            F.struct(gt_id, "difficult", "iou"), F.struct(F.col("iou"), -F.col(gt_id))
        ).alias("_m")
    ).select(*on, det_id, "_m.*")
    scored = det.join(best, [*on, det_id], "left")
    first = (
        scored.filter(F.col(gt_id).isNotNull())
        .groupBy(*on, gt_id)
        .agg(F.max_by(det_id, F.struct(F.col(score), -F.col(det_id))).alias("_first"))
    )
    out = join_on(scored, first, [*on, gt_id])
    matched = F.col(gt_id).isNotNull()
    counted = matched & ~F.coalesce(F.col("difficult"), F.lit(False))
    is_first = F.coalesce(F.col("_first") == F.col(det_id), F.lit(False))
    return (
        out.withColumn("tp", (counted & is_first).cast("int"))
        .withColumn("fp", (~matched | (counted & ~is_first)).cast("int"))
        .drop("_first")
    )


def _match_in_place(
    det: DataFrame, gt: DataFrame, on: Sequence[str], det_id: str, gt_id: str, score: str, min_iou: float
) -> DataFrame:
    """`match_truth` with a group's rows in two arrays; a NULL key has no truth."""
    own = [c for c in det.columns if c not in on]
    detection = F.struct(*own).alias("_d")
    truth = F.struct(F.col(gt_id).alias("id"), "difficult", *Box.of()).alias("_g")
    lacks = F.lit(None)
    both = det.select(*on, detection, lacks.cast(gt.select(truth).schema["_g"].dataType).alias("_g")).unionByName(
        gt.select(*on, lacks.cast(det.select(detection).schema["_d"].dataType).alias("_d"), truth)
    )
    listed = both.groupBy(*on).agg(F.collect_list("_d").alias("_d"), F.collect_list("_g").alias("_g"))
    known = F.lit(True)
    for k in on:
        known = known & F.col(k).isNotNull()

    def seen(d: Column) -> Column:
        # NULL sides meet nothing; the first truth wins a tie, so the smaller id
        def reached(g: Column) -> Column:
            whole = F.lit(True)
            for side in Box._fields:
                whole = whole & d[side].isNotNull() & g[side].isNotNull()
            return known & whole & (_iou_exact(Box.field(d), Box.field(g)) > min_iou)

        best = F.array_max(
            F.transform(
                F.filter("_g", reached),
                lambda g: F.struct(
                    _iou_exact(Box.field(d), Box.field(g)).alias("iou"), (-g["id"]).alias("_order"), g["id"].alias("id"),
                    g["difficult"].alias("difficult"),
                ),
            )
        )
        return F.struct(d.alias("d"), best.alias("m"), F.struct(d[score], -d[det_id]).alias("rank"))

    rows = listed.select(*on, F.transform("_d", seen).alias("_s")).select(*on, "_s", F.explode("_s").alias("_x"))
    # a detection is true unless a better one has the same truth
    beaten = F.exists("_s", lambda o: (o["m"]["id"] == F.col("_x.m.id")) & (o["rank"] > F.col("_x.rank")))
    matched = F.col("_x.m.id").isNotNull()
    counted = matched & ~F.coalesce(F.col("_x.m.difficult"), F.lit(False))
    first = ~F.coalesce(beaten, F.lit(False))
    found = [F.col("_x.m.id").alias(gt_id), F.col("_x.m.difficult").alias("difficult"), F.col("_x.m.iou").alias("iou")]
    return rows.select(
        *on, *(F.col("_x.d")[c].alias(c) for c in own), *found,
        (counted & first).cast("int").alias("tp"), (~matched | (counted & ~first)).cast("int").alias("fp"),
    )


def _iou_exact(a: Box, b: Box) -> Column:
    """Overlap without a guard, as evaluation counts it."""
    inter = B.intersection(a, b)
    return F.try_divide(inter, B.area(a, False) + B.area(b, False) - inter)


def overlapping(
    a: DataFrame, b: DataFrame, on: Sequence[str], test: Callable[[Box, Box], Column],
    cell: float = 64.0, pad: float = 0.0,
) -> DataFrame:
    """Rows of ``b`` that pass ``test(a_box, b_box)`` with some row of ``a``: a semi join.

    The test may only hold for boxes that touch within ``pad``.
    """
    mine = [F.col(c).alias(f"_k_{c}") for c in on]
    right, left = meeting(a.select(*mine, *Box.of().columns("_a_")), b, Box.of("_a_"), Box.of(), cell, pad)
    right = right.withColumnsRenamed({c: f"_a{c}" for c in MEET})
    cond = F.lit(True)
    for c in MEET:
        cond = cond & (F.col(c) == F.col(f"_a{c}"))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_k_{c}"))
    hit = left.join(right, cond & test(Box.of("_a_"), Box.of()), "left_semi")
    return hit.drop(*MEET).distinct()


def zbuffer(df: DataFrame, keys: Sequence[str], depth: str = "d") -> DataFrame:
    """Smallest depth of the points that land on one pixel."""
    return df.groupBy(*keys).agg(F.min(depth).alias(depth))


def with_calibration(
    df: DataFrame, cams: DataFrame, transforms: DataFrame | None = None, on: str = "camera",
    max_rows: int = 100_000,
) -> DataFrame:
    """Intrinsics and extrinsics joined to every row.

    The dimension is broadcast while it has at most ``max_rows`` rows.
    """
    from framewise.operators.dims import join_dim

    out = join_dim(df, cams, [on], max_rows)
    return out if transforms is None else join_dim(out, transforms, [on], max_rows)
