"""Streams that hold rows back: equal to sequential brute force, whatever the micro-batch cut."""

import random
from datetime import datetime, timedelta, timezone
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators.assign import best_matching, best_matchings
from framewise.operators.filters import throttle
from framewise.session import scratch_path
from framewise.streaming import stateful, topics

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def fed(spark, batches, schema, ts="ts", after=1000.0):
    """The batches as files of one stream, in their order, and a closing row."""
    path = scratch_path(spark, "fed")
    whole = spark.createDataFrame([row for b in batches for row in b], schema)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b-{n:03d}")
    topics.closed(whole, ts, after).write.parquet(f"{path}/b-{len(batches):03d}")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b-*")
    return whole, stream


def cuts(rows, n, rnd):
    at = sorted(rnd.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]


@pytest.mark.parametrize("n", [1, 4, 7])
def test_throttled_stream_equals_batch_on_shuffled_rows(spark, n):
    rnd = random.Random(n)
    rows = [(i % 5 if i % 11 else None, i, START + timedelta(seconds=rnd.randrange(300))) for i in range(200)]
    rnd.shuffle(rows)
    whole, stream = fed(spark, cuts(rows, n, rnd), "key long, id long, ts timestamp")
    got = topics.drain(stateful.throttle_stream(stream, "key", "ts", "id", 20.0, "400 seconds"), "shuffled")
    batch = throttle(whole.filter("key is not null"), "key", 20.0, "ts", "id")
    assert sorted(r.id for r in got.filter("key is not null").collect()) == sorted(r.id for r in batch.collect())
    assert got.filter("key is null").count() > 0
    assert got.filter("id is null").isEmpty()


def test_rows_behind_the_watermark_are_dropped(spark):
    def row(i, second):
        return (1, i, START + timedelta(seconds=second))

    batches = [[row(1, 0), row(2, 100)], [row(3, 200)], [row(4, 10), row(5, 201), row(6, 260)]]
    _, stream = fed(spark, batches, "key long, id long, ts timestamp")
    got = topics.drain(stateful.throttle_stream(stream, "key", "ts", "id", 20.0, "30 seconds"), "late")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 6]


def overlap(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def tracked(rows, min_iou, grow, patience):
    """The tracker frame by frame, trying all pairings."""
    out, known, following = {}, [], 0
    for frame in sorted({r[1] for r in rows}):
        dets = sorted(r for r in rows if r[1] == frame)
        k = (grow - 1) / 2
        wide = []
        for _, _, _, b in known:
            w, h = (b[2] - b[0]) * k, (b[3] - b[1]) * k
            wide.append((b[0] - w, b[1] - h, b[2] + w, b[3] + h))
        slots = [*range(len(known)), *([None] * len(dets))]
        best = max(
            set(permutations(slots, len(dets))),
            key=lambda p: sum(overlap(wide[i], d[3:]) for i, d in zip(p, dets) if i is not None),
        )
        now, used = [], set()
        for i, d in zip(best, dets):
            if i is not None and overlap(wide[i], d[3:]) > min_iou:
                used.add(i)
                now.append((known[i][0], known[i][1] + 1, 0, d[3:]))
            else:
                now.append((following, 1, 0, d[3:]))
                following += 1
            out[d[1], d[2]] = now[-1][:2]
        known = now + [(a, b, m + 1, c) for i, (a, b, m, c) in enumerate(known) if i not in used and m < patience]
    return out


@pytest.mark.parametrize(("n", "patience"), [(1, 0), (5, 0), (9, 2)])
def test_tracks_equal_a_sequential_tracker(spark, n, patience):
    rnd = random.Random(7)
    rows, det = [], 0
    for camera in (1, 2):
        people = [(rnd.uniform(0, 300), rnd.uniform(0, 300)) for _ in range(3)]
        for frame in range(15):
            for x, y in people:
                det += 1
                x, y = x + frame * 3 + rnd.uniform(-8, 8), y + rnd.uniform(-8, 8)
                if rnd.random() < 0.8:
                    rows.append((camera, frame, det, x, y, x + 60.0, y + 90.0))
    want = {}
    for camera in (1, 2):
        own = tracked([r for r in rows if r[0] == camera], 0.1, 1.25, patience)
        want |= {(camera, *k): v for k, v in own.items()}
    rnd = random.Random(n)
    rnd.shuffle(rows)  # frames fall apart over the micro-batches
    rows = [(*r, START + timedelta(seconds=r[1])) for r in rows]
    schema = "camera long, frame long, det long, xmin double, ymin double, xmax double, ymax double, ts timestamp"
    _, stream = fed(spark, cuts(rows, n, rnd), schema)
    out = stateful.track(stream, "camera", "frame", "det", 0.1, ts="ts", watermark="100 seconds", patience=patience)
    got = {(r.key, r.frame, r.det_id): (r.track, r.age) for r in topics.drain(out, "tracks").collect()}
    assert got == want


def test_closing_row(spark):
    df = spark.createDataFrame([(1, START)], "id int, ts timestamp").withColumn("n", F.lit(1.5))
    end = topics.closed(df, "ts", 5.0)
    assert end.schema.simpleString() == df.schema.simpleString()
    r = end.first()
    assert r.id is None and r.n is None and end.filter(F.unix_seconds("ts") - 5 == int(START.timestamp())).count() == 1


@pytest.mark.parametrize("n", [1, 5])
def test_missing_feedback_equals_one_pass_in_time_order(spark, n):
    rnd = random.Random(n)
    rows = []
    for i in range(260):
        kind = None if i % 53 == 0 else rnd.random() < 0.7
        rows.append((i % 3 if i % 17 else None, i, kind, START + timedelta(seconds=rnd.randrange(400) / 2)))
    whole, stream = fed(spark, cuts(rows, n, rnd), "key long, id long, kind boolean, ts timestamp")
    got = stateful.missing_feedback(stream, "key", "ts", "id", F.col("kind"), 4.0, 6.0, "400 seconds")
    got = {(r.key, r.id, r.missed, r.age) for r in topics.drain(got, "reports").collect()}
    want, seen, told, missed = set(), {}, {}, {}
    known = [(ts, kind, rid, key) for key, rid, kind, ts in rows if kind is not None]
    for ts, kind, rid, key in sorted(known, key=lambda x: x[:3]):
        if not kind:
            seen[key] = ts
        elif key not in seen or (ts - seen[key]).total_seconds() >= 4.0:
            missed[key] = missed.get(key, 0) + 1
            if key not in told or (ts - told[key]).total_seconds() > 6.0:
                age = (ts - seen[key]).total_seconds() if key in seen else None
                want.add((key, rid, missed.pop(key), age))
                told[key] = ts
    assert got == want
    assert len(want) > 10


def test_replay_bounds_the_rows_of_a_slice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topics, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    rows = [(i, START + timedelta(seconds=i)) for i in range(400)] + [(400, None)]
    log = spark.createDataFrame(rows, "id long, ts timestamp")
    topics.replay_stream(spark, log, slices=2, rows_per_slice=60)
    held = [sorted(r.id for r in spark.read.parquet(str(p)).collect()) for p in sorted(tmp_path.glob("replay/slice-*"))]
    assert [i for part in held for i in part] == list(range(400))
    assert len(held) == 7 and max(map(len, held)) <= 60


def test_very_many_keys_share_states(spark):
    rows = [(i % 3000, i, START + timedelta(seconds=i // 3000)) for i in range(6000)]
    whole, stream = fed(spark, [rows[:3000], rows[3000:]], "key long, id long, ts timestamp")
    out = scratch_path(spark, "many")
    query = (
        stateful.throttle_stream(stream, "key", "ts", "id", 0.5).writeStream.format("parquet")
        .option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= stateful.BUCKETS
    assert sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == list(range(6000))


def test_frame_zero_is_tracked(spark):
    path, names = scratch_path(spark, "zero"), "camera long, frame long, det_id long, xmin double, ymin double, xmax double, ymax double"
    for n, frames in enumerate([(0, 1, 2), (500,), (1000,)]):
        rows = [(1, f, 0, 0.0, 0.0, 10.0, 10.0) for f in frames]
        spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{path}/b-{n}")
    stream = spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(f"{path}/b-*")
    out = topics.drain(stateful.track(stream, "camera", "frame", "det_id"), "zero-out")
    assert {0, 1, 2} <= {r.frame for r in out.collect()}


def test_many_matchings_equal_single_ones():
    """Frames were matched one by one before; ties must go the same way."""
    rng = np.random.default_rng(3)
    for m, n in [(1, 1), (1, 4), (3, 2), (4, 4), (5, 7), (18, 17)]:
        for gain in (rng.random((30, m, n)), rng.integers(0, 4, (30, m, n)) / 3.0, np.zeros((2, m, n))):
            for one, of in zip(gain, best_matchings(gain)):
                assert sorted(best_matching(one)) == [(i, int(j)) for i, j in enumerate(of) if j >= 0]


def test_frames_of_a_batch_are_matched_at_once(monkeypatch):
    calls = []
    monkeypatch.setattr(stateful, "best_matchings", lambda gain: calls.append(gain.shape) or best_matchings(gain))
    rng = np.random.default_rng(4)
    sizes = np.array([0, 3, 3, 0, 2, 3, 3, 3])
    corner = rng.uniform(0, 40, (sizes.sum(), 2))
    boxes = np.hstack([corner, corner + rng.uniform(20, 60, corner.shape)])
    ends, want = np.cumsum(sizes), np.full(len(boxes), -1)
    for f in range(1, len(sizes)):
        known, now = range(ends[f - 1] - sizes[f - 1], ends[f - 1]), range(ends[f] - sizes[f], ends[f])
        if known and now:
            gain = stateful._iou_table(stateful._wider(boxes[known], 0.125), boxes[now])
            for i, j in best_matching(gain):
                want[now[j]] = known[i] if gain[i, j] > 0.1 else -1
    assert stateful._followed(boxes, sizes, 0.125, 0.1).tolist() == want.tolist()
    assert calls == [(3, 3, 3)]


def test_a_slice_is_written_by_all_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topics, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(topics, "ROWS_OF_A_WRITER", 10)
    log = spark.range(400).select("id", F.timestamp_seconds("id").alias("ts"))
    stream = topics.replay_stream(spark, log, slices=2, close_after=5.0)
    files = [len(list(p.glob("*.parquet"))) for p in sorted(tmp_path.glob("replay/slice-*"))]
    assert files == [8, 8, 1]
    monkeypatch.undo()
    assert sorted(r.id for r in topics.drain(stream, "cores").collect() if r.id is not None) == list(range(400))
