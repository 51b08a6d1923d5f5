"""Greedy thinning: segments that are walked whole, and rows of one stamp in two segments."""

import pytest

from framewise.operators import timeline as tl


@pytest.mark.parametrize("short", [0, 10_000])
def test_a_forced_row_does_not_keep_others_of_its_stamp(spark, monkeypatch, short):
    monkeypatch.setattr(tl, "SHORT", short)
    rows = [("u", 0.0, 1, 1), ("u", 1.0, 2, 1), ("u", 1.0, 3, 0), ("u", 1.5, 4, 1), ("u", 12.0, 5, 1), ("u", 12.5, 6, 1)]
    df = spark.createDataFrame(rows, "user string, s double, id long, active int")
    df = df.selectExpr("user", "timestamp_micros(cast(s * 1000000 as bigint)) AS ts", "id", "active")
    got = tl.schedule(df, "user", "ts", 10.0, active="active", tie="id")
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 5]


@pytest.mark.parametrize("short", [0, 3, 10_000])
def test_spacing_equals_a_walk(spark, monkeypatch, short):
    monkeypatch.setattr(tl, "SHORT", short)
    stamps = {u: sorted((i * i * (u + 7)) % 997 for i in range(60)) for u in range(4)}
    rows = [(u, t, i) for u, ts in stamps.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "user int, s long, id long").selectExpr("user", "timestamp_seconds(s) AS ts", "s", "id")
    got = tl.keep_spaced(df, "user", "ts", 20.0, "id", chunk=50.0)
    want = set()
    for u, ts in stamps.items():
        last = None
        for i, t in enumerate(ts):
            if last is None or t - last > 20:
                want.add((u, i))
                last = t
    assert {(r["user"], r["id"]) for r in got.collect()} == want
