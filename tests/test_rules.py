"""One rule for missing values and ties, whatever the size of a group or the type of an order."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.operators import assign, scale, suppress
from framewise.plans import perception
from framewise.session import cut_lineage, discard, shared_dir

BOX = "frame long, det_id long, score double, xmin double, ymin double, xmax double, ymax double"


def some_boxes(n=60):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        x, y = rnd.uniform(0, 90), rnd.uniform(0, 90)
        frame = rnd.choice([None, 1, 2])
        score = rnd.choice([None, float("nan"), rnd.random(), 0.5])
        rows.append((frame, i, score, x, y, x + rnd.uniform(5, 40), y + rnd.uniform(5, 40)))
    rows += [(1, n, 0.9, None, 1.0, None, 5.0), (None, n + 1, 0.8, 1.0, None, 4.0, 5.0), (2, n + 2, 0.7, None, None, None, None)]
    return rows


@pytest.mark.parametrize("name", ["nms", "nms_bottom"])
def test_suppression_is_the_same_on_both_sides_of_the_limit(spark, name):
    df = spark.createDataFrame(some_boxes(), BOX)
    fn = getattr(suppress, name)
    few, many = (sorted(r.det_id for r in fn(df, ["frame"], 0.3, limit=n).collect()) for n in (2048, 1))
    assert few == many and {60, 61, 62} <= set(few) and len(few) < 63


def test_groups_with_null_and_long_keys(spark):
    big = 2**53
    rows = [(None, i) for i in range(3)] + [(big, 1), (big + 1, 2), (big + 1, 3)]
    df = spark.createDataFrame(rows, "k long, v long")
    out = scale.map_groups(df, ["k"], lambda p: pd.DataFrame({"n": [len(p)]}), "n long")
    assert sorted(r.n for r in out.collect()) == [1, 2, 3]


@pytest.mark.parametrize("order", [["path"], ["price"], ["same", "path"], ["-path"]])
def test_every_order_is_cut_into_buckets(spark, order):
    rows = spark.range(2000).select(
        F.concat(F.lit("a/b/"), F.md5(F.col("id").cast("string"))).alias("path"),
        (F.col("id") / 7).cast("decimal(12,4)").alias("price"), F.lit(5).alias("same"),
    )
    cut = scale.with_buckets(rows, order, buckets=16)
    sizes = [r["count"] for r in cut.groupBy("_bucket").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 1000
    ranks = scale.ranked(rows, [], order, "rn").select("rn", *{o.lstrip("-") for o in order}).toPandas()
    by = [o.lstrip("-") for o in order]
    want = ranks.sort_values(by, ascending=[not o.startswith("-") for o in order])["rn"].tolist()
    assert want == list(range(1, 2001))


def best_total(pairs):
    """Largest total over all one-to-one choices, by enumeration."""
    best = (-1.0, ())
    for n in range(len(pairs) + 1):
        for some in itertools.combinations(pairs, n):
            if len({p[0] for p in some}) == len({p[1] for p in some}) == n:
                best = max(best, (sum(p[2] for p in some), tuple(sorted(p[:2] for p in some))))
    return best[1]


def test_ties_do_not_depend_on_order_or_parts(spark):
    box = "frame long, {0} long, xmin double, ymin double, xmax double, ymax double"
    a = [(1, i, 10.0 * i, 0.0, 10.0 * i + 20, 10.0) for i in range(4)]
    b = [(1, 10 + i, 10.0 * i, 0.0, 10.0 * i + 20, 10.0) for i in (0, 0, 1, 3)]
    b = [(f, 10 + n, *rest) for n, (f, _, *rest) in enumerate(b)]
    found = set()
    for seed in range(3):
        rnd = random.Random(seed)
        left, right = rnd.sample(a, len(a)), rnd.sample(b, len(b))
        out = assign.assign(
            spark.createDataFrame(left, box.format("a_id")), spark.createDataFrame(right, box.format("b_id")),
            ["frame"], min_iou=0.0, tie=lambda x, y: (x * 31 + y * 17) % 101 / 101.0,
        )
        found.add(tuple(sorted((r.a_id, r.b_id) for r in out.collect())))

    def iou(p, q):
        inter = max(0.0, min(p[4], q[4]) - max(p[2], q[2])) * 10
        return inter / (400 - inter)

    pairs = [
        (p[1], q[1], iou(p, q) + (p[1] * 31 + q[1] * 17) % 101 / 101 * assign.TIE) for p in a for q in b if iou(p, q) > 0
    ]
    assert found == {best_total(pairs)}


def test_points_outside_the_image_have_no_class(spark):
    grid = spark.createDataFrame([(x, y, c, float(c == x)) for x in range(3) for y in range(3) for c in range(3)], "gu long, gv long, cls int, val double")
    pts = spark.createDataFrame(
        [(1, 0, -0.5, 1.0), (1, 1, 1.0, 1.0), (1, 2, 2.0, 2.0), (1, 3, 2.2, 1.0), (1, 4, 0.25, 1.5)],
        "frame long, pt_id long, u double, v double",
    )
    got = {r.pt_id: r.segm_class for r in perception.segment_points(pts, grid, []).collect()}
    assert got == {0: -1, 1: 1, 2: 2, 3: -1, 4: 0}


def test_tables_of_finished_rounds_are_deleted(spark):
    shared_dir(spark)
    df = cut_lineage(spark.range(5))
    assert df.count() == 5
    place = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(place)
    discard(df)
    assert not files.exists(place)
    discard(spark.range(1))
