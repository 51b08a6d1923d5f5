"""One-to-one association of boxes and tracks at least total cost."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions import boxes as B
from framewise.functions.boxes import Box
from framewise.operators.grid import MEET, at_home, meeting
from framewise.operators.neighbours import components
from framewise.operators.scale import join_on, map_groups
from framewise.session import cut_lineage


SMALL = 256  # cells up to which a dense matching is walked without arrays


def best_matching(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a matching of largest total gain, by shortest augmenting paths.

    Absent pairs have gain 0. Small dense helper for one part of a frame.
    """
    flipped = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flipped else gain)
    rows, cols = cost.shape
    if rows * cols <= SMALL:
        pairs = _small_matching(cost.tolist(), cols)
        return [(c, r) for r, c in pairs] if flipped else pairs
    row_of, col_of = np.full(cols, -1), np.full(rows, -1)
    u, v = np.zeros(rows), np.zeros(cols)
    for start in range(rows):
        dist, via = np.full(cols, np.inf), np.full(cols, -1)
        closed = np.zeros(cols, dtype=bool)
        row, base = start, 0.0
        visited = [start]
        while True:
            reach = base + cost[row] - u[row] - v
            better = ~closed & (reach < dist)
            dist[better], via[better] = reach[better], row
            col = int(np.argmin(np.where(closed, np.inf, dist)))
            base = dist[col]
            closed[col] = True
            if row_of[col] < 0:
                break
            row = int(row_of[col])
            visited.append(row)
        for r in visited[1:]:
            u[r] += base - dist[col_of[r]]
        u[start] += base
        v[closed] -= base - dist[closed]
        row = -1
        while row != start:
            row = int(via[col])
            row_of[col] = row
            col_of[row], col = col, int(col_of[row])
    pairs = [(r, int(col_of[r])) for r in range(rows)]
    return [(c, r) for r, c in pairs] if flipped else pairs


def best_matchings(gain: np.ndarray) -> np.ndarray:
    """`best_matching` of many tables (table, row, column) of one shape at once: each row's column, or -1.

    The steps are those of `best_matching`, taken in all tables together, so ties go the same way.
    """
    if gain.shape[1] > gain.shape[2]:
        of = best_matchings(np.swapaxes(gain, 1, 2))
        out = np.full(gain.shape[:2], -1)
        out[np.arange(len(gain))[:, None], of] = np.arange(gain.shape[2])
        return out
    cost = -gain
    tables, rows, cols = cost.shape
    every = np.arange(tables)
    row_of, col_of = np.full((tables, cols), -1), np.full((tables, rows), -1)
    u, v = np.zeros((tables, rows)), np.zeros((tables, cols))
    for start in range(rows):
        dist, via = np.full((tables, cols), np.inf), np.full((tables, cols), -1)
        closed, visited = np.zeros((tables, cols), dtype=bool), np.zeros((tables, rows), dtype=bool)
        base, end = np.zeros(tables), np.zeros(tables, dtype=np.int64)
        live, row = every, np.full(tables, start)
        while len(live):
            reach = base[live, None] + cost[live, row] - u[live, row][:, None] - v[live]
            shut, far = closed[live], dist[live]
            better = ~shut & (reach < far)
            far = np.where(better, reach, far)
            dist[live], via[live] = far, np.where(better, row[:, None], via[live])
            col = np.argmin(np.where(shut, np.inf, far), axis=1)
            base[live], end[live] = far[np.arange(len(live)), col], col
            closed[live, col] = True
            row = row_of[live, col]
            live, row = live[row >= 0], row[row >= 0]
            visited[live, row] = True
        u = np.where(visited, u + (base[:, None] - dist[every[:, None], col_of]), u)
        u[:, start] += base
        v = np.where(closed, v - (base[:, None] - dist), v)
        live, col = every, end
        while len(live):
            row = via[live, col]
            row_of[live, col] = row
            before = col_of[live, row]
            col_of[live, row] = col
            live, col = live[row != start], before[row != start]
    return col_of


def _small_matching(cost: list[list[float]], cols: int) -> list[tuple[int, int]]:
    """The steps of `best_matching` on plain numbers, which arrays of a few cells only slow down."""
    inf = float("inf")
    row_of, col_of = [-1] * cols, [-1] * len(cost)
    u, v = [0.0] * len(cost), [0.0] * cols
    for start in range(len(cost)):
        dist, via, closed = [inf] * cols, [-1] * cols, [False] * cols
        row, base, visited = start, 0.0, [start]
        while True:
            own, off, col, least = cost[row], u[row], 0, inf
            for j in range(cols):
                if closed[j]:
                    continue
                reach = base + own[j] - off - v[j]
                if reach < dist[j]:
                    dist[j], via[j] = reach, row
                if dist[j] < least:
                    col, least = j, dist[j]
            base = dist[col]
            closed[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
            visited.append(row)
        for r in visited[1:]:
            u[r] += base - dist[col_of[r]]
        u[start] += base
        for j in range(cols):
            if closed[j]:
                v[j] -= base - dist[j]
        row = -1
        while row != start:
            row = via[col]
            row_of[col] = row
            col_of[row], col = col, col_of[row]
    return list(enumerate(col_of))


def sparse_matching(gains: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Pairs of a matching of largest total gain, among the given ones only.

    Shortest augmenting paths over adjacency lists: memory is linear in the pairs, and a
    path visits only what it needs to. A row may stay alone, at a column of its own.
    """
    rows = 1 + max(i for i, _ in gains)
    near: list[list[tuple[int, float]]] = [[(-1 - i, 0.0)] for i in range(rows)]
    for (i, j), g in gains.items():
        near[i].append((j, -g))
    u, v = [0.0] * rows, {}
    row_of: dict[int, int] = {}
    col_of: dict[int, int] = {}
    for start in range(rows):
        dist, via, closed = {}, {}, set()
        heap: list[tuple[float, int]] = []
        row, base, visited = start, 0.0, [start]
        while True:
            for col, cost in near[row]:
                reach = base + cost - u[row] - v.get(col, 0.0)
                if col not in closed and reach < dist.get(col, np.inf):
                    dist[col], via[col] = reach, row
                    heapq.heappush(heap, (reach, col))
            base, col = heapq.heappop(heap)
            while col in closed:
                base, col = heapq.heappop(heap)
            closed.add(col)
            if col not in row_of:
                break
            row = row_of[col]
            visited.append(row)
        for r in visited[1:]:
            u[r] += base - dist[col_of[r]]
        u[start] += base
        for c in closed:
            v[c] = v.get(c, 0.0) - (base - dist[c])
        row = -1
        while row != start:
            row = via[col]
            row_of[col] = row
            col, col_of[row] = col_of.get(row, col), col
    return [(i, j) for i, j in col_of.items() if j >= 0]


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    ai, bi = (pd.factorize(pdf[c], sort=True)[0].tolist() for c in ("_a", "_b"))
    # of rows of one pair, which repeated ids give, the best
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for row, (pair, gain) in enumerate(zip(zip(ai, bi), pdf["_gain"].tolist(), strict=True)):
        if pair not in best or gain > best[pair][0]:
            best[pair] = gain, row
    chosen = sparse_matching({pair: gain for pair, (gain, _) in best.items()})
    return pdf.iloc[sorted(best[pair][1] for pair in chosen)]


def settle(pairs: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs that are in every best matching, pairs that are left to decide).

    A pair whose gain exceeds the best other gains of its two ends together is taken: whatever
    two pairs a matching has instead of it gain less. Pairs at the ends of a taken one go.
    """
    by_gain = [F.desc("_gain"), "_a", "_b"]
    marked = pairs
    for side in ("_a", "_b"):
        best = Window.partitionBy(*on, side).orderBy(*by_gain)
        marked = marked.withColumns({
            f"_first{side}": F.row_number().over(best) == 1,
            f"_next{side}": F.lead("_gain", 1, 0.0).over(best),
        })
    sure = F.col("_first_a") & F.col("_first_b") & (F.col("_gain") > F.col("_next_a") + F.col("_next_b"))
    marked = marked.withColumn("_sure", sure)
    for side in ("_a", "_b"):
        marked = marked.withColumn(f"_gone{side}", F.max("_sure").over(Window.partitionBy(*on, side)))
    out = cut_lineage(marked.filter(F.col("_sure") | ~(F.col("_gone_a") | F.col("_gone_b"))).select(*pairs.columns, "_sure"))
    return out.filter("_sure").drop("_sure"), out.filter("NOT _sure").drop("_sure")


def solve_pairs(pairs: DataFrame, on: Sequence[str], limit: int = 64, shrink: float = 0.1) -> DataFrame:
    """Matching of largest total ``_gain`` (> 0) among candidate pairs ``_a``, ``_b``.

    Pairs that no best matching lacks are taken by joins, in rounds as long as a round takes
    away ``shrink`` of the open pairs. The rest
    falls into the connected parts of each group's candidate graph, which are
    independent problems; groups with more than ``limit`` open pairs are cut into
    these parts, smaller ones are solved as they come.
    """
    names = pairs.columns
    plain: DataFrame | None = None
    open_pairs, before = pairs, None
    while True:
        sure, open_pairs = settle(open_pairs, on)
        plain = sure if plain is None else plain.unionByName(sure)
        left = open_pairs.count()
        if not left:
            return plain
        if before is not None and left > (1.0 - shrink) * before:
            break
        before = left

    sizes = open_pairs.groupBy(*on).agg(F.count(F.lit(1)).alias("_open"))
    sized = join_on(open_pairs, sizes, on)
    few = sized.filter(F.col("_open") <= limit).drop("_open").withColumn("_part", F.lit(""))
    many = sized.filter(F.col("_open") > limit).drop("_open")
    work = few
    if not many.isEmpty():
        ends = many.select(
            *on, F.concat(F.lit("a"), "_a").alias("a"), F.concat(F.lit("b"), "_b").alias("b")
        )
        part = components(ends, on).select(
            *on, F.col("vertex").alias("_v"), F.col("component").alias("_part")
        )
        cut = join_on(many.withColumn("_v", F.concat(F.lit("a"), "_a")), part, [*on, "_v"])
        work = few.unionByName(cut.drop("_v"))
    solved = map_groups(work, [*on, "_part"], _solve, work.schema).drop("_part")
    return plain.unionByName(solved).select(*names)


def _pairs(
    a: DataFrame, b: DataFrame, on, a_id: str, b_id: str, cell: float, reach: Column | None = None
) -> DataFrame:
    """Pairs of a group whose boxes meet once ``a`` is grown by ``reach``, once each."""
    grown = B.ordered(Box.of())
    if reach is not None:
        grown = Box(grown.xmin - reach, grown.ymin - reach, grown.xmax + reach, grown.ymax + reach)
    left = a.select(
        *on, F.col(a_id).alias("_a"), *(F.col(c).alias(f"_ra_{c}") for c in a.columns),
        *(c.alias(f"_g{n}") for n, c in zip(Box._fields, grown)),
    )
    right = b.select(
        *on, F.col(b_id).alias("_b"), *(F.col(c).alias(f"_rb_{c}") for c in b.columns), *Box.of().columns("_h")
    )
    ga, gb = Box.of("_g"), B.ordered(Box.of("_h"))
    left, right = meeting(left, right, ga, gb, cell)
    home = at_home((ga.xmin, ga.ymin), (gb.xmin, gb.ymin), cell)
    rows = [
        F.struct(*(F.col(f"{name}_{c}").alias(c) for c in side.columns)).alias(name)
        for name, side in (("_ra", a), ("_rb", b))
    ]
    return left.join(right, [*on, *MEET]).filter(home).select(*on, "_a", "_b", *rows)


# what a pair's tie value, from 0 to 1, adds to its gain
TIE = 1e-7


def tie_by_hash(a: Column, b: Column) -> Column:
    """A number from 0 to 1 that depends on nothing but the two ids."""
    return F.pmod(F.xxhash64(a, b), F.lit(1021)) / 1021.0


def assign(
    a: DataFrame, b: DataFrame, on: Sequence[str], a_id: str = "a_id", b_id: str = "b_id",
    min_iou: float = 0.40, cell: float = 64.0, tie: Callable[[Column, Column], Column] = tie_by_hash,
) -> DataFrame:
    """Least-cost pairing of boxes with cost 1 - IoU; pairs with IoU <= ``min_iou`` go afterwards.

    Boxes that do not overlap cost 1 and are dropped by the gate anyway, so only
    overlapping pairs are candidates. Rows: on, a_id, b_id, iou. Pairings whose total
    IoU is equal to within ``TIE`` per pair are ties: of them the one with the largest
    sum of ``tie`` values is taken, whatever the order or the parts they are solved in.
    """
    pairs = _pairs(a, b, on, a_id, b_id, cell)
    pairs = pairs.withColumn(
        "_iou", B.iou(Box.field(F.col("_ra")), Box.field(F.col("_rb")))
    ).filter("_iou > 0").select(
        *on, "_a", "_b", "_iou", (F.col("_iou") + tie(F.col("_a"), F.col("_b")) * TIE).alias("_gain")
    )
    matched = solve_pairs(pairs, on)
    # not as costs: 1 - IoU rounds to 1 - min_iou for an IoU just above it
    return matched.filter(F.col("_iou") > min_iou).select(
        *on, F.col("_a").alias(a_id), F.col("_b").alias(b_id), F.col("_iou").alias("iou")
    )


# exp(-x) of a double is 0 beyond this x
_UNDERFLOW = 745.2


def associate_tracks(
    cur: DataFrame, prev: DataFrame, on: Sequence[str], similarity: Callable[[Column, Column], Column],
    a_id: str = "person", b_id: str = "track", w_iou: float = 0.5, min_iou: float = 0.2,
    min_oks: float = 0.3, min_obs: int = 3, min_parts: int = 5, max_kappa: float = 0.0458,
    cell: float = 256.0,
) -> DataFrame:
    """Persons joined to tracks at cost 1 - (w * IoU + (1 - w) * OKS).

    ``similarity(person_row, track_row)`` gives the OKS of two row structs, scaled by
    the area of the person's box. Returns the persons with ``track`` and ``num_obs``
    (NULL track when new), and tracks without a partner that have more than
    ``min_obs`` observations and more than ``min_parts`` parts as placeholder rows.

    Keypoints so far apart that the similarity is 0 in double precision cannot pair
    boxes that do not meet, so the candidates lie within that reach of a person's box.
    """
    reach = F.sqrt(B.area(Box.of()) * (2.0 * max_kappa * _UNDERFLOW))
    pairs = _pairs(cur, prev, on, a_id, b_id, cell, reach)
    iou = B.iou(Box.field(F.col("_ra")), Box.field(F.col("_rb")))
    gain = iou * w_iou + similarity(F.col("_ra"), F.col("_rb")) * (1.0 - w_iou)
    pairs = pairs.withColumn("_gain", gain).filter("_gain > 0").select(*on, "_a", "_b", "_gain")
    gate = w_iou * min_iou + (1.0 - w_iou) * min_oks
    matched = cut_lineage(
        solve_pairs(pairs, on).filter(F.col("_gain") > gate)
    )
    seen = matched.select(*on, F.col("_a").alias(a_id), F.col("_b").alias(b_id))
    with_track = join_on(cur, seen, [*on, a_id])
    obs = prev.select(*on, b_id, F.col("num_obs").alias("_obs"))
    persons = join_on(with_track, obs, [*on, b_id]).select(
        *on, a_id, b_id, (F.coalesce("_obs", F.lit(-1)) + 1).alias("num_obs"),
        F.lit(False).alias("placeholder"),
    )
    lost = prev.join(seen.select(*on, b_id), [*on, b_id], "left_anti").filter(
        (F.col("num_obs") > min_obs) & (F.col("n_parts") > min_parts)
    )
    ghosts = lost.select(
        *on, F.lit(None).cast(cur.schema[a_id].dataType).alias(a_id), b_id,
        F.col("num_obs").cast("int").alias("num_obs"), F.lit(True).alias("placeholder"),
    )
    return persons.withColumn("num_obs", F.col("num_obs").cast("int")).unionByName(ghosts)


def keep_occluded(b: DataFrame, matches: DataFrame, on: Sequence[str], b_id: str) -> DataFrame:
    """Rows without partner that are more than half occluded, marked fully occluded, score 0.

    Needs ``n_valid``, ``n_occluded``, ``score`` and ``kps`` with ``conf`` and ``occluded``.
    """
    alone = b.join(matches.select(*on, b_id), [*on, b_id], "left_anti")
    share = F.try_divide(F.col("n_occluded").cast("double"), F.col("n_valid").cast("double"))
    hidden = F.transform(
        "kps",
        lambda k: k.withField("occluded", k["occluded"] | (k["conf"] > 0)).withField(
            "conf", F.lit(0.0)
        ),
    )
    return (
        alone.filter(share > 0.5)
        .withColumn("score", F.lit(0.0))
        .withColumn("n_occluded", F.col("n_valid"))
        .withColumn("kps", hidden)
    )


def replace_occluded(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Joints occluded in the partner take its position and covariance, confidence 0.

    Both sides carry ``kps``; ``b``'s keypoints have ``occluded``. The originals stay
    in ``kps_orig``, ``n_occluded`` and ``n_valid`` are updated.
    """
    fb = b.select(*on, F.col("kps").alias("_fb"))
    joined = a.join(fb, list(on), "left")

    def merge(k: Column, f: Column) -> Column:
        fields = ["x", "y", "cov_xx", "cov_xy", "cov_yy"]
        take = F.coalesce(f["occluded"], F.lit(False))
        return F.struct(
            *(F.when(take, f[n]).otherwise(k[n]).alias(n) for n in fields),
            F.when(take, F.lit(0.0)).otherwise(k["conf"]).alias("conf"),
            take.alias("occluded"),
        )

    both = F.when(F.col("_fb").isNull(), F.transform("kps", lambda k: merge(k, k.withField("occluded", F.lit(False)))))
    both = both.otherwise(F.zip_with("kps", "_fb", merge))
    out = joined.withColumn("_new", both)
    hidden = F.size(F.filter("_new", lambda k: k["occluded"]))
    revived = F.size(
        F.filter(
            F.zip_with("_new", "kps", lambda n, k: n["occluded"] & (k["conf"] == 0)), lambda x: x
        )
    )
    return (
        out.withColumn("n_occluded", F.col("n_occluded") + hidden)
        .withColumn("n_valid", F.col("n_valid") + revived)
        .withColumn("kps_orig", F.col("kps"))
        .withColumn("kps", F.col("_new"))
        .drop("_new", "_fb")
    )
