"""One-to-one association: settled pairs, connected parts and the sparse solver against the dense one."""

import random
import time

import numpy as np
import pytest

from framewise.operators import assign as A


def dense_total(gains):
    table = np.zeros((1 + max(i for i, _ in gains), 1 + max(j for _, j in gains)))
    for (i, j), g in gains.items():
        table[i, j] = g
    return sum(table[i, j] for i, j in A.best_matching(table))


def one_to_one(pairs):
    return len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


@pytest.mark.parametrize("share", [0.05, 0.3, 1.0])
def test_sparse_solver_has_the_total_of_the_dense_one(share):
    rnd = random.Random(int(share * 100))
    for _ in range(60):
        n, m = rnd.randint(1, 25), rnd.randint(1, 25)
        gains = {(i, j): rnd.random() for i in range(n) for j in range(m) if rnd.random() < share} or {(0, 0): 0.5}
        got = A.sparse_matching(gains)
        assert one_to_one(got) and set(got) <= set(gains)
        assert sum(gains[p] for p in got) == pytest.approx(dense_total(gains), abs=1e-9)


def test_one_large_part_needs_no_dense_matrix():
    rnd = random.Random(4)
    n = 100_000  # a chain: row i meets columns i and i + 1
    gains = {(i, j): rnd.random() for i in range(n) for j in (i, i + 1)}
    start = time.time()
    got = A.sparse_matching(gains)
    assert time.time() - start < 60 and one_to_one(got)
    # the best total of a path graph, link by link
    skip, take = 0.0, 0.0
    for i in range(n):
        for j in (i, i + 1):
            skip, take = max(skip, take), skip + gains[i, j]
    assert sum(gains[p] for p in got) == pytest.approx(max(skip, take), abs=1e-6)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_groups_are_solved_whole(spark, limit):
    rnd = random.Random(2)
    groups = {}
    for g in range(12):
        n = rnd.randint(2, 30)
        groups[g] = {(i, j): rnd.random() ** 3 for i in range(n) for j in range(n) if rnd.random() < rnd.choice([0.05, 0.3])}
        groups[g][0, 0] = 0.9
    groups[12] = {(0, 0): 0.4, (0, 1): 0.3, (1, 0): 0.3}  # the best pair alone is not the best matching
    groups[13] = {(0, 0): 0.7, (0, 1): 0.3, (1, 0): 0.3}  # here it is
    rows = [(None if g == 5 else g, i, j, v) for g, own in groups.items() for (i, j), v in own.items()]
    df = spark.createDataFrame(rows, "frame int, _a long, _b long, _gain double")
    found = {}
    for r in A.solve_pairs(df, ["frame"], limit).collect():
        found.setdefault(5 if r.frame is None else r.frame, []).append((r._a, r._b))
    assert set(found) == set(groups)
    for g, own in groups.items():
        assert one_to_one(found[g])
        assert sum(own[p] for p in found[g]) == pytest.approx(dense_total(own), abs=1e-9)
    assert sorted(found[12]) == [(0, 1), (1, 0)] and found[13] == [(0, 0)]
    assert A.solve_pairs(df.limit(0), ["frame"]).count() == 0


def test_settled_pairs_are_in_the_best_matching(spark):
    rnd = random.Random(9)
    gains = {(i, j): rnd.random() ** 4 for i in range(40) for j in range(40) if rnd.random() < 0.05}
    df = spark.createDataFrame([(0, *p, g) for p, g in gains.items()], "frame int, _a long, _b long, _gain double")
    sure, left = A.settle(df, ["frame"])
    taken = {(r._a, r._b) for r in sure.collect()}
    best = set(A.sparse_matching(gains))
    assert taken and taken <= best
    rest = {(r._a, r._b): r._gain for r in left.collect()}
    total = sum(gains[p] for p in taken) + (sum(rest[p] for p in A.sparse_matching(rest)) if rest else 0.0)
    assert total == pytest.approx(sum(gains[p] for p in best), abs=1e-9)


def test_an_overlap_just_above_the_gate_stays(spark):
    names = "frame long, {0} long, xmin double, ymin double, xmax double, ymax double"
    gate = 0.1
    side = gate
    while side / (1.0 + side - side + np.finfo(float).eps) <= gate:
        side = float(np.nextafter(side, 1))
    assert not 1.0 - side / (1.0 + np.finfo(float).eps) < 1.0 - gate
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (2, 1, 0.0, 0.0, 1.0, 1.0)], names.format("a_id"))
    b = spark.createDataFrame([(1, 7, 0.0, 0.0, 1.0, side), (2, 7, 0.0, 0.0, 1.0, 0.0999)], names.format("b_id"))
    assert [(r.frame, r.a_id, r.b_id) for r in A.assign(a, b, ["frame"], min_iou=gate).collect()] == [(1, 1, 7)]


def test_repeated_ids_are_matched_once_at_their_best(spark):
    rows = [(0, 1, 1, 0.3), (0, 1, 1, 0.5), (0, 1, 1, 0.5), (0, 1, 2, 0.4), (0, 2, 1, 0.4)]
    df = spark.createDataFrame(rows, "frame int, _a long, _b long, _gain double")
    got = sorted((r._a, r._b) for r in A.solve_pairs(df, ["frame"]).collect())
    assert got == [(1, 2), (2, 1)]
    alone = spark.createDataFrame(rows[:3], "frame int, _a long, _b long, _gain double")
    assert [(r._a, r._b, r._gain) for r in A.solve_pairs(alone, ["frame"]).collect()] == [(1, 1, 0.5)]
