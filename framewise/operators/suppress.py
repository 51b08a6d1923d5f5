"""Non-maximum suppression and other greedy keeping of boxes.

Groups up to ``limit`` rows are folded in place, one array per group. Larger
groups never meet in one task. Where boxes have few others near them, the pairs that
exclude each other become a graph, and blocks of ``BLOCK`` boxes are settled at a time:
a box whose earlier rivals are all gone is kept, one with a kept rival goes, and a
block follows such a chain to its border in one round. Crowds are thinned first, by
rounds over the cells of a grid with a level per size: every cell names its best
undecided box; a box that is best in all its cells is kept, and boxes it overlaps too
much go. All ways give the same result as the sequential scan.

A NULL frame or class is a group like any other. A box with a NULL side overlaps
nothing: it is kept and takes no other box away. A NULL score comes before all
others and NaN after them, as the sort of the scan has it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions import boxes as B
from framewise.functions.boxes import Box
from framewise.operators.grid import MEET, at_home, climbing, levels_in, meeting, padded
from framewise.operators.scale import SMALL_GROUP, groups_are_small, max_group, split_by_size
from framewise.operators.spatial import overlapping
from framewise.session import cut_lineage, discard

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS  # boxes settled in one place
CROWD = 512  # near boxes of a box, on average, from which on cells are thinned first
HIT = -1  # in place of an earlier rival: it was kept

# overlap(kept, candidate); positive only when the boxes touch within one pixel
Overlap = Callable[[Box, Box], Column]

OVERLAPS: dict[str, Overlap] = {
    "plain": B.iou,
    "pixel": lambda a, b: B.iou(a, b, normalized=False),
    "self": B.pixel_overlap_of_second,
    "grid": lambda a, b: B.intersection(a, b, 1.0)
    / (B.area(a) + B.area(b) - B.intersection(a, b, 1.0) + B.EPS),
}


def _sort_key(order: Sequence[str]) -> list[Column]:
    """Columns whose ascending order is ``order``; numbers are negated for descending."""
    return [
        (-F.col(o[1:]) if o.startswith("-") else F.col(o)).alias(f"_o{i}")
        for i, o in enumerate(order)
    ]


def _fold(df: DataFrame, keys: Sequence[str], order, overlap: Overlap, t: float) -> DataFrame:
    """Scan each group's boxes in order, keep those no kept one overlaps."""
    entry = F.struct(
        *_sort_key(order), *Box.of().columns("_"),
        F.struct(*(c for c in df.columns if c not in keys)).alias("_row"),
    )

    def box(s: Column) -> Box:
        return Box(s["_xmin"], s["_ymin"], s["_xmax"], s["_ymax"])

    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    kept = F.aggregate(
        "_l", F.slice("_l", 1, 0),
        lambda acc, new: F.when(
            F.exists(acc, lambda old: overlap(box(old), box(new)) > t), acc
        ).otherwise(F.concat(acc, F.array(new))),
    )
    return listed.select(*keys, F.explode(kept).alias("_k")).select(*keys, "_k._row.*")


def _rounds(df: DataFrame, keys: Sequence[str], order, overlap: Overlap, t: float) -> DataFrame:
    """The same for groups of any size."""
    columns = df.columns
    # one text per group, so that joins pair NULL keys too
    df = df.withColumn("_group", F.to_json(F.struct(*keys))).withColumn("_rank", F.struct(*_sort_key(order)))
    b = B.ordered(Box.of())
    side = F.greatest(b.xmax - b.xmin, b.ymax - b.ymin)
    typical = df.agg(F.exp(F.avg(F.log(F.when((side > 0) & (side < float("inf")), side))))).first()[0] or 1.0
    cell = max(typical / 4, 1e-9)
    open_rows = cut_lineage(df)
    kept: DataFrame | None = None
    while not open_rows.isEmpty():
        if _near(open_rows, cell) <= CROWD * open_rows.count():
            won, open_rows = _settled(open_rows, overlap, t, cell, typical), None
        else:
            won, open_rows = _thinned(open_rows, overlap, t, cell)
        kept = won if kept is None else kept.unionByName(won)
        if open_rows is None:
            break
    return df.limit(0).select(*columns) if kept is None else kept.select(*columns)


def _near(rows: DataFrame, cell: float) -> int:
    """How many pairs of boxes share a cell, each box with itself included."""
    slim = rows.select("_group", *Box.of())
    at = ["_group", *MEET]
    left, right = (
        x.groupBy(*at).agg(F.count(F.lit(1)).alias(n))
        for x, n in zip(meeting(slim, slim, Box.of(), Box.of(), cell, 1.0), ("_n", "_m"))
    )
    return left.join(right, at).agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0


def _thinned(rows: DataFrame, overlap: Overlap, t: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """(boxes that are best in all their cells, boxes these do not take away)."""
    part, key = ["_group", *MEET[:3]], ["_group", "_rank"]
    box = padded(Box.of(), 1.0)
    cells = climbing(rows.select(*key, *Box.of()), box, levels_in(rows, Box.of(), cell, 1.0), cell)
    own = F.col("_role") == 0
    # smaller boxes that are looked up in a cell are rivals of its own boxes, not of each other
    tops = cells.groupBy(*part).agg(F.min("_rank").alias("_top"), F.min(F.when(own, F.col("_rank"))).alias("_own"))
    seen = cells.select(*part, "_rank", "_role").join(tops, part)
    best = F.when(own, F.col("_rank") == F.col("_top")).otherwise(F.coalesce(F.col("_rank") < F.col("_own"), F.lit(True)))
    winners = seen.groupBy(*key).agg(F.bool_and(best).alias("_best")).filter("_best").select(*key)
    won = cut_lineage(rows.join(winners, key, "left_semi"))
    if won.isEmpty():
        raise RuntimeError("no box of the round is best in its cells; is the order unique?")
    rest = rows.join(won.select(*key), key, "left_anti")
    hit = overlapping(won, rest, ["_group"], lambda a, b: overlap(a, b) > t, cell=cell, pad=1.0)
    left = cut_lineage(rest.join(hit.select(*key), key, "left_anti"))
    discard(rows)
    return won, left


def _settled(rows: DataFrame, overlap: Overlap, t: float, cell: float, typical: float) -> DataFrame:
    """Boxes kept of all in ``rows``, by the graph of pairs that exclude each other."""
    # neighbours get numbers near each other: the high bits of a number name a block
    tile = [F.floor((F.col(f"{a}min") + F.col(f"{a}max")) / (typical * 16)).alias(f"_t{a}") for a in "xy"]
    n = max(1, min(rows.count() // BLOCK, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    placed = rows.select("*", *tile).repartitionByRange(n, "_group", "_tx", "_ty")
    placed = placed.sortWithinPartitions("_group", "_tx", "_ty", "xmin", "ymin")
    numbered = cut_lineage(placed.drop("_tx", "_ty").withColumn("_id", F.monotonically_increasing_id()))
    discard(rows)
    box = ["_group", "_id", "_rank", *Box._fields]
    one = numbered.select(*(F.col(c).alias("_group" if c == "_group" else f"_i{c}") for c in box))
    left, right = meeting(one, numbered.select(*box), Box.of("_i"), Box.of(), cell, 1.0)
    near = left.join(right, ["_group", *MEET])
    i, j = padded(Box.of("_i"), 1.0), padded(Box.of(), 1.0)
    near = near.filter(at_home((i.xmin, i.ymin), (j.xmin, j.ymin), cell) & (F.col("_i_id") != F.col("_id")))
    first = near.filter((F.col("_i_rank") < F.col("_rank")) & (overlap(Box.of("_i"), Box.of()) > t))
    rivals = cut_lineage(first.select(F.col("_i_id").alias("src"), F.col("_id").alias("dst")))
    undecided, kept = cut_lineage(numbered.select(F.col("_id").alias("dst"))), None
    while not undecided.isEmpty():
        undecided, rivals, won = _settle_blocks(undecided, rivals)
        kept = won if kept is None else kept.unionByName(won)
    return cut_lineage(numbered.join(kept, "_id", "left_semi"))


def _settle_blocks(undecided: DataFrame, rivals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (numbers still open, their open earlier rivals, numbers kept)."""
    rows = undecided.select("dst", F.lit(None).cast("long").alias("src")).unionByName(rivals.select("dst", "src"))
    block = F.shiftright("dst", BLOCK_BITS).alias("block")
    said = rows.select(block, "dst", "src").groupBy("block").applyInPandas(_settle, "id long, kept boolean")
    said = cut_lineage(said)
    left = cut_lineage(undecided.join(said.select(F.col("id").alias("dst")), "dst", "left_anti"))
    known = rivals.join(left, "dst", "left_semi").join(said, rivals["src"] == said["id"], "left")
    # a rival that went is no rival, one that was kept decides
    now = known.filter(F.coalesce("kept", F.lit(True))).select(
        "dst", F.when(F.col("kept"), F.lit(HIT).cast("long")).otherwise(F.col("src")).alias("src")
    )
    out = left, cut_lineage(now), said.filter("kept").select(F.col("id").alias("_id"))
    discard(undecided)
    discard(rivals)
    return out


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decide what can be decided in one block: boxes without open earlier rivals are kept, which
    takes away the later ones they exclude, and so on."""
    ids = np.unique(pdf["dst"].to_numpy())
    edge = pdf[pdf["src"].notna()]
    dst = np.searchsorted(ids, edge["dst"].to_numpy())
    src = edge["src"].to_numpy(np.int64)
    waits = np.bincount(dst, minlength=len(ids))
    state = np.zeros(len(ids), np.int8)  # 1 kept, -1 gone
    gone = list(dict.fromkeys(dst[src == HIT].tolist()))
    state[gone] = -1
    at = np.minimum(np.searchsorted(ids, src), len(ids) - 1)
    inside = ids[at] == src
    by = np.argsort(at[inside], kind="stable")
    later = dst[inside][by]
    starts = np.searchsorted(at[inside][by], np.arange(len(ids) + 1))
    todo = [*gone, *np.flatnonzero((waits == 0) & (state == 0)).tolist()]
    for v in todo:
        if state[v] == 0:
            state[v] = 1
        for w in later[starts[v] : starts[v + 1]].tolist():
            if state[w]:
                continue
            waits[w] -= 1
            if state[v] == 1:
                state[w] = -1
                todo.append(w)
            elif waits[w] == 0:
                todo.append(w)
    known = state != 0
    return pd.DataFrame({"id": ids[known], "kept": state[known] == 1})


def greedy_keep(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], overlap: Overlap, t: float,
    limit: int = 2048, known_size: int | None = None,
) -> DataFrame:
    """Boxes kept by a scan in ``order``; ``order`` must be unique within ``keys``.

    Boxes with a NULL side are kept whatever their group's size.

    ``known_size`` is a bound on the group size the caller already guarantees.
    """
    whole = _whole_box()
    odd, df = df.filter(~whole), df.filter(whole)
    size = known_size if known_size is not None else max_group(df, keys)
    if size <= limit:
        return _fold(df, keys, order, overlap, t).unionByName(odd)
    few, many = split_by_size(df, keys, limit)
    kept = _fold(few, keys, order, overlap, t).unionByName(_rounds(many, keys, order, overlap, t))
    return kept.unionByName(odd)


def nms(
    df: DataFrame, keys: Sequence[str], t: float, score: str = "score", det_id: str = "det_id",
    iou: str = "plain", limit: int = 2048, known_size: int | None = None,
) -> DataFrame:
    """Greedy NMS per ``keys``: best score first, ties by id.

    ``keys`` is the frame, or frame and class. ``iou``: ``plain``, ``pixel`` or ``grid``.
    """
    return greedy_keep(df, keys, [f"-{score}", det_id], OVERLAPS[iou], t, limit, known_size)


def nms_bottom(
    df: DataFrame, keys: Sequence[str], t: float, det_id: str = "det_id", limit: int = 2048
) -> DataFrame:
    """Variant from the bottom of the image up; overlap is relative to the candidate."""
    return greedy_keep(df, keys, ["-ymax", f"-{det_id}"], OVERLAPS["self"], t, limit)


def nms_persons(
    df: DataFrame, keys: Sequence[str], t: float = 0.40, touch: float = 0.03,
    score: str = "conf", person_id: str = "person", limit: int = 2048, cell: float = 64.0,
) -> DataFrame:
    """NMS on persons; of two that overlap a little the smaller loses ``estimate_depth``.

    The pass compares each kept person with all persons after it in score order that
    are still in the list at that moment, so a person removed later can still take
    the flag from an earlier one. Where no group is large, each is compared in place.
    """
    if groups_are_small(keys, df, most=limit):
        return _persons_in_place(df, keys, t, touch, score, person_id)
    kept = nms(df, keys, t, score, person_id, limit=limit)
    one = kept.select(*keys, F.col(person_id).alias("_i"), F.col(score).alias("_si"), *Box.of().columns("_i_"))
    two = df.select(*keys, F.col(person_id).alias("_j"), F.col(score).alias("_sj"), *Box.of().columns("_j_"))
    bi, bj = Box.of("_i_"), Box.of("_j_")
    overlap = B.iou(bi, bj)
    after = (F.col("_si") > F.col("_sj")) | (
        (F.col("_si") == F.col("_sj")) & (F.col("_i") < F.col("_j"))
    )
    left, right = meeting(one, two, bi, bj, cell)
    pairs = left.join(right, [*keys, *MEET]).filter(after & (overlap > touch) & (overlap <= t))
    # when i is compared, j is still listed unless a kept person before i removed it
    remover = _first_remover(kept, df, keys, t, score, person_id, cell)
    pairs = pairs.join(remover, [*keys, "_j"], "left").filter(
        F.col("_rs").isNull()
        | (F.col("_rs") < F.col("_si"))
        | ((F.col("_rs") == F.col("_si")) & (F.col("_r") >= F.col("_i")))
    )
    loser = F.when(B.area(bi) < B.area(bj), F.col("_i")).otherwise(F.col("_j"))
    flagged = pairs.select(*keys, loser.alias(person_id)).distinct().withColumn("_flag", F.lit(1))
    return (
        kept.join(flagged, [*keys, person_id], "left")
        .withColumn("estimate_depth", F.col("_flag").isNull())
        .drop("_flag")
    )


def _whole_box() -> Column:
    whole = F.lit(True)
    for side in Box._fields:
        whole = whole & F.col(side).isNotNull()
    return whole


def _persons_in_place(
    df: DataFrame, keys: Sequence[str], t: float, touch: float, score: str, person_id: str
) -> DataFrame:
    """`nms_persons` with a group's rows in one array; no flag is taken in a group of a NULL key."""
    whole = _whole_box()
    odd = df.filter(~whole).withColumn("estimate_depth", F.lit(True))
    entry = F.struct(
        *_sort_key([f"-{score}", person_id]), *Box.of().columns("_"), F.col(person_id).alias("_i"), F.col(score).alias("_s"),
        F.struct(*(c for c in df.columns if c not in keys)).alias("_row"),
    )

    def box(s: Column) -> Box:
        return Box(s["_xmin"], s["_ymin"], s["_xmax"], s["_ymax"])

    def ahead(a: Column, b: Column) -> Column:
        return (a["_s"] > b["_s"]) | ((a["_s"] == b["_s"]) & (a["_i"] < b["_i"]))

    listed = df.filter(whole).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    kept = F.aggregate(
        "_l", F.slice("_l", 1, 0),
        lambda acc, new: F.when(F.exists(acc, lambda old: B.iou(box(old), box(new)) > t), acc).otherwise(
            F.concat(acc, F.array(new))
        ),
    )

    def with_remover(x: Column) -> Column:
        # the first kept one, in score order, that removes a person
        gone = ~F.coalesce(F.exists("_k", lambda k: k["_i"] == x["_i"]), F.lit(False))
        by = F.filter("_k", lambda k: ahead(k, x) & (B.iou(box(k), box(x)) > t))
        first = F.array_max(F.transform(by, lambda k: F.struct(k["_s"].alias("s"), (-k["_i"]).alias("i"))))
        return F.struct(x.alias("x"), F.when(gone, first).alias("by"))

    def losers(i: Column) -> Column:
        def meets(j: Column) -> Column:
            listed_still = j["by"].isNull() | (j["by"]["s"] < i["_s"]) | (
                (j["by"]["s"] == i["_s"]) & (-j["by"]["i"] >= i["_i"])
            )
            overlap = B.iou(box(i), box(j["x"]))
            return ahead(i, j["x"]) & (overlap > touch) & (overlap <= t) & listed_still

        return F.transform(
            F.filter("_j", meets), lambda j: F.when(B.area(box(i)) < B.area(box(j["x"])), i["_i"]).otherwise(j["x"]["_i"])
        )

    rows = listed.withColumn("_k", kept)
    rows = rows.withColumn("_j", F.transform("_l", with_remover))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    lost = F.when(known, F.flatten(F.transform("_k", losers)))
    rows = rows.select(*keys, "_k", lost.alias("_lost")).select(*keys, "_lost", F.explode("_k").alias("_x"))
    flagged = F.coalesce(F.array_contains("_lost", F.col("_x._i")), F.lit(False))
    return rows.select(*keys, "_x._row.*", (~flagged).alias("estimate_depth")).unionByName(odd)


def _first_remover(kept, df, keys, t, score, person_id, cell) -> DataFrame:
    """For each removed person the first kept one, in score order, that removes it."""
    one = kept.select(*keys, F.col(person_id).alias("_r"), F.col(score).alias("_rs"), *Box.of().columns("_r_"))
    gone = df.join(kept.select(*keys, person_id), [*keys, person_id], "left_anti")
    two = gone.select(*keys, F.col(person_id).alias("_j"), F.col(score).alias("_js"), *Box.of().columns("_j_"))
    before = (F.col("_rs") > F.col("_js")) | (
        (F.col("_rs") == F.col("_js")) & (F.col("_r") < F.col("_j"))
    )
    left, right = meeting(one, two, Box.of("_r_"), Box.of("_j_"), cell)
    hit = left.join(right, [*keys, *MEET]).filter(
        before & (B.iou(Box.of("_r_"), Box.of("_j_")) > t)
    )
    first = hit.groupBy(*keys, "_j").agg(
        F.max_by(F.struct("_r", "_rs"), F.struct(F.col("_rs"), -F.col("_r"))).alias("_f")
    )
    return first.select(*keys, "_j", "_f.*")


def append_no_overlap(
    a: DataFrame, b: DataFrame, keys: Sequence[str], t: float = 0.1, order: Sequence[str] = ("det_id",),
    limit: int = 2048, cell: float = 64.0,
) -> DataFrame:
    """``a`` and the rows of ``b`` that overlap neither ``a`` nor an accepted earlier row of ``b``."""
    if groups_are_small(keys, a, b, most=limit):
        whole = _whole_box()
        boxes = a.filter(whole).select(*(F.col(k).alias(f"_k_{k}") for k in keys), *Box.of().columns("_a_"))
        hit = whole & (B.iou(Box.of("_a_"), Box.of()) > t)
        for k in keys:
            hit = hit & (F.col(k) == F.col(f"_k_{k}"))
        # the join leaves a group's rows together, where the scan wants them
        return a.unionByName(greedy_keep(b.join(boxes, hit, "left_anti"), keys, list(order), B.iou, t, limit, SMALL_GROUP))
    blocked = overlapping(a, b, keys, lambda p, q: B.iou(p, q) > t, cell)
    free = b.join(blocked.select(*b.columns).distinct(), b.columns, "left_anti")
    return a.unionByName(greedy_keep(free, keys, list(order), B.iou, t, limit))


def union_detections(objects: DataFrame, persons: DataFrame, cap: float = 0.99) -> DataFrame:
    """Objects and persons in one list; a person's score is capped."""
    return objects.unionByName(
        persons.withColumn("score", F.least(F.col("score"), F.lit(cap)))
    )
