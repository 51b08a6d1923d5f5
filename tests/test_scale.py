"""Operators on a hot key give what a plain window or a sequential scan gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewise.functions.boxes import Box
from framewise.operators import neighbours as nb
from framewise.operators import scale, suppress
from framewise.operators import timeline as tl
from framewise.operators.assign import best_matching


def skewed(spark, n=3000):
    """A third of the rows share one key, and a third of those one value."""
    i = F.col("id")
    key = F.when(i % 3 == 0, F.lit(0)).otherwise(i % 50)
    value = F.when(i % 9 == 0, F.lit(5.0)).otherwise((F.xxhash64("id") % 1000).cast("double"))
    return spark.range(n).select("id", key.alias("k"), value.alias("v"))


@pytest.mark.parametrize("order", [["v", "id"], ["-v", "id"]])
@pytest.mark.parametrize("buckets", [3, 40])
def test_ranked_equals_window(spark, order, buckets):
    df = scale.with_buckets(skewed(spark), order, "_b", buckets)
    got = scale.ranked(df, ["k"], order, "rn", bucket="_b").select("id", "rn")
    w = Window.partitionBy("k").orderBy(*scale.order_columns(order))
    want = skewed(spark).select("id", F.row_number().over(w).cast("long").alias("rn"))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_hot_value_is_split(spark):
    df = scale.with_buckets(skewed(spark), ["v", "id"], "_b", 16)
    sizes = df.filter("k = 0 and v = 5.0").groupBy("_b").count()
    assert sizes.count() > 1


def boxes(spark, n, frames, seed=1):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 120, n), rng.uniform(0, 90, n)
    w, h = rng.uniform(5, 60, n), rng.uniform(5, 60, n)
    pdf = pd.DataFrame(
        {
            "frame": rng.integers(0, frames, n), "det_id": np.arange(n), "label": rng.integers(0, 3, n),
            "score": rng.integers(0, 40, n) / 40.0, "xmin": x, "ymin": y, "xmax": x + w, "ymax": y + h,
        }
    )
    return spark.createDataFrame(pdf), pdf


def iou(a, b, pixel=0.0):
    w = min(a.xmax, b.xmax) - max(a.xmin, b.xmin) + pixel
    h = min(a.ymax, b.ymax) - max(a.ymin, b.ymin) + pixel
    inter = max(w, 0) * max(h, 0)
    size = [(s.xmax - s.xmin + pixel) * (s.ymax - s.ymin + pixel) for s in (a, b)]
    return inter / (sum(size) - inter)


def scan(pdf, t, pixel=0.0):
    kept = set()
    for _, group in pdf.groupby("frame"):
        order = group.sort_values(["score", "det_id"], ascending=[False, True])
        good = []
        for row in order.itertuples():
            if all(iou(o, row, pixel) <= t for o in good):
                good.append(row)
        kept |= {r.det_id for r in good}
    return kept


@pytest.mark.parametrize("iou_kind,pixel", [("plain", 0.0), ("pixel", 1.0)])
def test_nms_by_rounds_equals_scan(spark, iou_kind, pixel):
    df, pdf = boxes(spark, 260, 2)
    want = scan(pdf, 0.3, pixel)
    fold = suppress.nms(df, ["frame"], 0.3, iou=iou_kind)
    rounds = suppress.nms(df, ["frame"], 0.3, iou=iou_kind, limit=10)
    for got in (fold, rounds):
        ids = [r.det_id for r in got.collect()]
        assert len(ids) == len(set(ids)) and set(ids) == want


def test_nms_golden(spark):
    rows = [
        (1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 0.0, 4.0, 10.0, 14.0), (1, 3, 0.7, 0.0, 8.0, 10.0, 18.0)
    ]
    df = spark.createDataFrame(rows, "frame long, det_id long, score double, xmin double, ymin double, xmax double, ymax double")
    assert {r.det_id for r in suppress.nms(df, ["frame"], 0.3).collect()} == {1, 3}


def greedy(pdf, spacing):
    kept = []
    for _, group in pdf.sort_values(["us", "id"]).groupby("k"):
        last = None
        for us, i in zip(group["us"], group["id"]):
            if last is None or us - last > spacing:
                kept.append(i)
                last = us
    return set(kept)


@pytest.mark.parametrize("chunk", [0.05, 3.0, 1e6])
def test_keep_spaced_on_a_dense_key(spark, chunk):
    rng = np.random.default_rng(3)
    us = np.r_[np.cumsum(rng.integers(0, 40_000, 800)), rng.integers(0, 60_000_000, 300)]
    pdf = pd.DataFrame({"id": np.arange(1100), "k": [0] * 800 + list(rng.integers(1, 20, 300)), "us": us})
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("us")).drop("us")
    got = {r.id for r in tl.keep_spaced(df, "k", "ts", 0.09, tie="id", chunk=chunk).collect()}
    assert got == greedy(pdf, 90_000)


@pytest.mark.parametrize("chunk", [0.5, 1e6])
def test_asof_does_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    a = pd.DataFrame({"k": 1, "i": np.arange(200), "us": rng.integers(0, 20_000_000, 200)})
    b = pd.DataFrame({"k": 1, "j": np.arange(60), "us": rng.integers(0, 20_000_000, 60)})
    dfs = [spark.createDataFrame(p).withColumn("ts", F.timestamp_micros("us")).drop("us") for p in (a, b)]
    got = tl.asof(dfs[0], dfs[1], "k", "ts", ["j"], tie="j", chunk=chunk).toPandas().set_index("i")["b_j"]
    for row in a.itertuples():
        older = b[b.us <= row.us].sort_values(["us", "j"])
        want = None if older.empty else older.iloc[-1].j
        have = got[row.i]
        assert (want is None and pd.isna(have)) or want == have


def test_knn_equals_brute_force_on_uneven_cloud(spark):
    rng = np.random.default_rng(7)
    xyz = np.r_[rng.normal(0, 0.05, (150, 3)), rng.uniform(-5, 5, (60, 3)), np.zeros((12, 3))]
    pdf = pd.DataFrame(xyz, columns=list("xyz")).assign(frame=0, pt_id=np.arange(len(xyz)))
    got = nb.knn(spark.createDataFrame(pdf), 6).toPandas().sort_values(["pt_id", "rank"])
    d2 = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(axis=2)
    for i in range(len(xyz)):
        want = sorted(range(len(xyz)), key=lambda j: (d2[i, j], j))[:6]
        assert list(got[got.pt_id == i].nb_id) == want


def test_components(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": 0, "a": rng.integers(0, 300, 220), "b": rng.integers(0, 300, 220)})
    chain = pd.DataFrame({"g": 1, "a": np.arange(60), "b": np.arange(1, 61)})
    edges = pd.concat([pdf, chain])
    got = nb.components(spark.createDataFrame(edges), ["g"]).toPandas()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g, a, b in edges[["g", "a", "b"]].itertuples(index=False):
        x, y = sorted((find((g, a)), find((g, b))))
        root[y] = x
    assert len(got) == len(root)
    for row in got.itertuples():
        assert find((row.g, row.vertex))[1] == row.component


def test_matching_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(11)
    for shape in [(2, 3), (3, 2), (4, 4), (5, 3), (1, 1)]:
        for _ in range(20):
            gain = np.where(rng.random(shape) < 0.4, 0, rng.random(shape))
            got = sum(gain[i, j] for i, j in best_matching(gain))
            g = gain if shape[0] <= shape[1] else gain.T
            best = max(sum(g[i, p[i]] for i in range(len(g))) for p in permutations(range(g.shape[1]), len(g)))
            assert abs(got - best) < 1e-9


def test_assign_cuts_large_groups_into_parts(spark):
    from framewise.operators import assign as asg

    df, pdf = boxes(spark, 120, 1, seed=13)
    a = df.filter("label = 0").select("frame", F.col("det_id").alias("_a"), *Box._fields)
    b = df.filter("label > 0").select("frame", F.col("det_id").alias("_b"), *(F.col(c).alias(f"b{c}") for c in Box._fields))
    pairs = a.join(b, "frame").withColumn(
        "_gain", F.expr("greatest(least(xmax, bxmax) - greatest(xmin, bxmin), 0) * greatest(least(ymax, bymax) - greatest(ymin, bymin), 0)")
    ).filter("_gain > 0").select("frame", "_a", "_b", "_gain")
    whole = asg.solve_pairs(pairs, ["frame"], limit=10**6).agg(F.sum("_gain")).first()[0]
    cut = asg.solve_pairs(pairs, ["frame"], limit=1).agg(F.sum("_gain")).first()[0]
    assert abs(whole - cut) < 1e-6
