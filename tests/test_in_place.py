"""Small groups are compared in place: the same rows as by cells, and no cells in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from framewise.operators import evaluate, neighbours, scale, spatial, suppress


def boxes(spark, rnd, n, base=0, frames=6):
    rows = []
    for i in range(n):
        x, y = rnd.randrange(0, 60), rnd.randrange(0, 60)
        frame = None if i % 17 == 0 else rnd.randrange(frames)
        side = None if i % 13 == 0 else float(x + rnd.randrange(10, 60))
        score = rnd.choice([0.25, 0.5, 0.75, rnd.random()])
        rows.append((frame, base + i, rnd.randrange(3), score, float(x), float(y), side, float(y + rnd.randrange(10, 60)), i % 7 == 0))
    names = "frame long, det_id long, label long, score double, xmin double, ymin double, xmax double, ymax double, difficult boolean"
    return spark.createDataFrame(rows, names).cache()


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def both_ways(monkeypatch, run):
    near = run()
    assert "_cx" not in plan(near)
    monkeypatch.setattr(scale, "SMALL_GROUP", -1)
    far = run()
    columns = sorted(far.columns)
    assert columns == sorted(near.columns)
    got, want = (sorted(map(repr, df.select(columns).collect())) for df in (near, far))
    assert got == want and got


def test_persons(spark, monkeypatch):
    df = boxes(spark, random.Random(1), 120).drop("label", "difficult")
    both_ways(monkeypatch, lambda: suppress.nms_persons(df, ["frame"], 0.4, 0.03, "score", "det_id"))


def test_append(spark, monkeypatch):
    a, b = boxes(spark, random.Random(2), 30), boxes(spark, random.Random(3), 90, 1000)
    both_ways(monkeypatch, lambda: suppress.append_no_overlap(a, b, ["frame"], 0.1).fillna(-1))


@pytest.mark.parametrize("ask", ["points_in_box", "best_box"])
def test_points(spark, monkeypatch, ask):
    rnd = random.Random(4)
    pts = [(rnd.randrange(6) if i % 9 else None, i, rnd.uniform(0, 90), rnd.uniform(0, 90)) for i in range(80)]
    pts = spark.createDataFrame(pts, "frame long, pt_id long, u double, v double")
    df = boxes(spark, rnd, 60)
    if ask == "points_in_box":
        both_ways(monkeypatch, lambda: spatial.points_in_box(pts, df, ["frame"]))
    else:
        both_ways(monkeypatch, lambda: spatial.best_box(pts, df, ["frame"], "pt_id", "det_id", F.col("label") == 1))


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_truths(spark, monkeypatch, least):
    det = boxes(spark, random.Random(5), 150).drop("difficult")
    moved = [(F.col(c) + 1.0).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    gt = det.filter("det_id % 2 = 0").select("frame", "label", (F.col("det_id") + 7).alias("gt_id"), *moved, (F.col("det_id") % 5 == 0).alias("difficult"))
    both_ways(monkeypatch, lambda: spatial.match_truth(det, gt, ["frame", "label"], "det_id", "gt_id", min_iou=least))


def test_average_precision_reads_the_curve_once(spark):
    curve = spark.createDataFrame([("a", 0.35, 0.5), ("a", 0.65, 0.4), ("b", None, 1.0), ("b", 0.0, 0.2)], "label string, recall double, precision double")
    out = evaluate.average_precision(curve)
    got = {r.label: r.ap for r in out.collect()}
    assert got["a"] == pytest.approx((4 * 0.5 + 3 * 0.4) / 11) and got["b"] == pytest.approx(0.2 / 11)
    assert got[None] == pytest.approx((got["a"] + got["b"]) / 2)
    assert "LocalRelation" not in plan(out) and "LogicalRDD" not in plan(out)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, monkeypatch, kind):
    rnd = random.Random(6)
    ends = [(rnd.randrange(40) if rnd.random() > 0.05 else None, rnd.randrange(40)) for _ in range(150)]
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5]), u, v) for u, v in ends] + [(9, 3, 3), (9, 4, 3), (9, 4, 3), (9, 10, 9)]
    df = spark.createDataFrame(rows, "frame long, a long, b long").withColumns({c: F.col(c).cast(kind) for c in "ab"})

    def found():
        out = neighbours.components(df, ["frame"])
        return sorted(map(repr, out.select("frame", "vertex", "component").collect()))

    monkeypatch.setattr(neighbours, "cut_lineage", None)  # one array for a group needs no rounds
    near = found()
    monkeypatch.undo()
    monkeypatch.setattr(neighbours, "LISTED", -1)
    assert near == found() and near


def test_components_of_structs(spark, monkeypatch):
    """Cells are structs, which one array could not tell apart."""
    rnd = random.Random(8)
    ends = [[(rnd.randrange(3), rnd.choice([None, 1, 2]), rnd.randrange(3)) for _ in range(2)] for _ in range(25)]
    cell = "struct<x: long, y: long, z: long>"
    df = spark.createDataFrame([(i % 2, u, v) for i, (u, v) in enumerate(ends)] + [(1, None, None)], f"frame long, a {cell}, b {cell}")

    def found():
        out = neighbours.components(df, ["frame"])
        return sorted(map(repr, out.select("frame", "vertex", "component").collect()))

    near = found()
    monkeypatch.setattr(neighbours, "LISTED", -1)
    assert near == found() and near
