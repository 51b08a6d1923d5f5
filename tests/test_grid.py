"""The grid with a level per size: same pairs as brute force, few rows per box, chains of boxes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.functions.boxes import Box
from framewise.operators import grid, spatial, suppress


def boxes_of(rng, n, sizes, frame=1):
    x, y = rng.uniform(0, 900, n), rng.uniform(0, 900, n)
    w, h = rng.choice(sizes, n) * rng.uniform(0.5, 1, n), rng.choice(sizes, n) * rng.uniform(0.5, 1, n)
    return pd.DataFrame(
        {"frame": frame, "det_id": np.arange(n), "score": rng.permutation(n) / n, "xmin": x, "ymin": y, "xmax": x + w, "ymax": y + h}
    )


def test_a_box_is_at_most_four_rows(spark):
    rng = np.random.default_rng(1)
    df = boxes_of(rng, 500, [0.0, 1e-3, 3, 64, 500, 1e6, 1e12])
    rows = grid.own_cells(spark.createDataFrame(df), Box.of(), 64.0)
    assert max(r["count"] for r in rows.groupBy("det_id").count().collect()) <= 4
    # each row is looked up once at each level above, in four cells at most
    levels = grid.levels_in(spark.createDataFrame(df), Box.of(), 64.0)
    n = len(set(r._lv for r in rows.select("_lv").distinct().collect()))
    up = grid.climbing(spark.createDataFrame(df), Box.of(), levels, 64.0)
    assert max(r["count"] for r in up.groupBy("det_id").count().collect()) <= 4 * n


def test_one_frame_sized_box_among_many_small_ones(spark):
    rng = np.random.default_rng(2)
    small = boxes_of(rng, 100_000, [2.0]).assign(frame=1)
    giant = pd.DataFrame([{"frame": 1, "det_id": 100_000, "score": 1.0, "xmin": -1e6, "ymin": -1e6, "xmax": 1e6, "ymax": 1e6}])
    both = pd.concat([small, giant], ignore_index=True)
    df = spark.createDataFrame(both)
    assert grid.own_cells(df, Box.of(), 64.0).filter("det_id = 100000").count() <= 4
    pts = pd.DataFrame({"frame": 1, "pt_id": np.arange(300), "u": rng.uniform(0, 900, 300), "v": rng.uniform(0, 900, 300)})
    got = spatial.points_in_box(spark.createDataFrame(pts), df, ["frame"]).select("pt_id", "det_id").collect()
    u, v = pts["u"].to_numpy()[:, None], pts["v"].to_numpy()[:, None]
    inside = (u > both["xmin"].to_numpy()) & (u < both["xmax"].to_numpy()) & (v > both["ymin"].to_numpy()) & (v < both["ymax"].to_numpy())
    assert {(r.pt_id, r.det_id) for r in got} == set(zip(*map(np.ndarray.tolist, np.nonzero(inside))))
    assert len(got) == inside.sum()


@pytest.mark.parametrize("pad", [0.0, 1.0])
def test_boxes_meet_once_whatever_their_sizes(spark, pad):
    rng = np.random.default_rng(3)
    a, b = boxes_of(rng, 150, [1, 5, 70, 900, 0.0]), boxes_of(rng, 170, [2, 30, 64, 400, 1e5])
    left, right = spark.createDataFrame(a), spark.createDataFrame(b).withColumnsRenamed({c: f"b_{c}" for c in b.columns})
    bb = Box.of("b_")
    l, r = grid.meeting(left, right, Box.of(), bb, 16.0, pad)
    pa, pb = grid.padded(Box.of(), pad), grid.padded(bb, pad)
    home = grid.at_home((pa.xmin, pa.ymin), (pb.xmin, pb.ymin), 16.0)
    got = l.join(r, list(grid.MEET)).filter(home).select("det_id", "b_det_id").collect()
    x = [(a[c].to_numpy()[:, None], b[c].to_numpy()) for c in ("xmin", "xmax", "ymin", "ymax")]
    gap = 2 * pad
    touch = (x[0][0] <= x[1][1] + gap) & (x[0][1] <= x[1][0] + gap) & (x[2][0] <= x[3][1] + gap) & (x[2][1] <= x[3][0] + gap)
    found = [(int(p), int(q)) for p, q in got]
    assert len(found) == len(set(found))
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(touch)))) <= set(found)


def scan(df, t):
    """Boxes kept, one after the other."""
    kept, out = np.zeros((0, 4)), []
    rows = df.sort_values(["score", "det_id"], ascending=[False, True])
    for i, box in zip(rows["det_id"], rows[["xmin", "ymin", "xmax", "ymax"]].to_numpy()):
        low, high = np.maximum(kept[:, :2], box[:2]), np.minimum(kept[:, 2:], box[2:])
        inter = np.prod(np.clip(high - low, 0, None), axis=1)
        size = np.prod(kept[:, 2:] - kept[:, :2], axis=1) + np.prod(box[2:] - box[:2])
        if not (inter / (size - inter + 2.220446049250313e-16) > t).any():
            kept, out = np.vstack([kept, box]), [*out, i]
    return set(out)


def staircase(n):
    """Each box overlaps the next only; scores fall along the stairs."""
    x = np.arange(n) * 6.0
    return pd.DataFrame({"frame": 1, "det_id": np.arange(n), "score": 1 - np.arange(n) / n, "xmin": x, "ymin": x, "xmax": x + 10, "ymax": x + 10})


def test_a_staircase_takes_few_rounds(spark, monkeypatch):
    rounds = []
    inner = suppress._settle_blocks
    monkeypatch.setattr(suppress, "_settle_blocks", lambda *a: rounds.append(1) or inner(*a))
    df = staircase(10_000)
    got = suppress.nms(spark.createDataFrame(df), ["frame"], 0.05, limit=100)
    assert {r.det_id for r in got.select("det_id").collect()} == set(range(0, 10_000, 2))
    assert 1 <= len(rounds) <= 20


@pytest.mark.parametrize("crowd, bits", [(1 << 30, 12), (1 << 30, 5), (0, 12)])
def test_all_ways_keep_the_boxes_of_the_scan(spark, monkeypatch, crowd, bits):
    monkeypatch.setattr(suppress, "CROWD", crowd)
    monkeypatch.setattr(suppress, "BLOCK_BITS", bits)
    monkeypatch.setattr(suppress, "BLOCK", 1 << bits)
    rng = np.random.default_rng(4)
    df = boxes_of(rng, 200 if crowd else 15, [40, 60, 100, 800])
    if crowd:  # thinning alone takes a round per step
        df = pd.concat([df, staircase(80).assign(det_id=lambda d: d["det_id"] + 200)], ignore_index=True)
    df = pd.concat([df, df.assign(frame=2, score=1 - df["score"])], ignore_index=True)
    got = suppress.nms(spark.createDataFrame(df), ["frame"], 0.1, limit=10).select("frame", "det_id").collect()
    for frame, part in df.groupby("frame"):
        assert {r.det_id for r in got if r.frame == frame} == scan(part, 0.1)
    assert len(got) == len({(r.frame, r.det_id) for r in got})
