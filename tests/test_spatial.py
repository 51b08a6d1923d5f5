"""Spatial joins: both ways of the box scan, and plans without pair lists."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framewise.operators import spatial
from framewise.operators.aggregate import topk
from framewise.sources.writers import persons_to_json


def scene(spark, n_boxes=40, n_points=200):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 100, n_boxes), rng.uniform(0, 100, n_boxes)
    boxes = pd.DataFrame(
        {
            "frame": 1, "det_id": np.arange(n_boxes), "label": rng.integers(1, 6, n_boxes), "xmin": x, "ymin": y,
            "xmax": x + rng.uniform(5, 90, n_boxes), "ymax": y + rng.uniform(5, 90, n_boxes),
        }
    )
    pts = pd.DataFrame({"frame": 1, "pt_id": np.arange(n_points), "u": rng.uniform(0, 150, n_points), "v": rng.uniform(0, 150, n_points)})
    return spark.createDataFrame(pts), spark.createDataFrame(boxes), pts, boxes


def scan(point, boxes):
    cur = None
    for b in boxes.sort_values("det_id").itertuples():
        if not (b.xmin < point.u < b.xmax and b.ymin < point.v < b.ymax):
            continue
        if cur is not None and b.label != 1:
            size = (b.xmax - b.xmin) * (b.ymax - b.ymin)
            w = max(min(b.xmax, cur.xmax) - max(b.xmin, cur.xmin), 0)
            h = max(min(b.ymax, cur.ymax) - max(b.ymin, cur.ymin), 0)
            old = (cur.xmax - cur.xmin) * (cur.ymax - cur.ymin)
            if not (b.label != cur.label and size < old and w * h / size > 0.5):
                continue
        cur = b
        if b.label == 1:
            break
    return None if cur is None else cur.det_id


def test_best_box_both_ways(spark):
    pts, boxes, p, b = scene(spark)
    want = {row.pt_id: scan(row, b) for row in p.itertuples()}
    want = {k: v for k, v in want.items() if v is not None}
    for limit in (512, 0):
        got = spatial.best_box(pts, boxes, ["frame"], "pt_id", "det_id", F.col("label") == 1, limit=limit)
        assert {r.pt_id: r.det_id for r in got.collect()} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    pts, boxes, _, _ = scene(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(spatial.points_in_box(pts, boxes, ["frame"]))
        assert "NestedLoop" not in joined and "Cartesian" not in joined
        assert "WindowGroupLimit" in plan(topk(boxes, ["frame"], ["-label", "det_id"], 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_frame_is_one_document(spark):
    rows = spark.range(6000).select(
        (F.col("id") % 2).alias("camera"), F.when(F.col("id") < 5990, 1).alias("stamp"), "id", F.lit(0.5).alias("score")
    )
    out = persons_to_json(rows, ["camera", "stamp"], F.col("id"), columns=("id", "score"))
    people = {(r.camera, r.stamp): __import__("json").loads(r.json)["people"] for r in out.collect()}
    assert {k: len(v) for k, v in people.items()} == {(0, 1): 2995, (1, 1): 2995, (0, None): 5, (1, None): 5}
    assert [p["id"] for p in people[1, None]] == [5991, 5993, 5995, 5997, 5999]
