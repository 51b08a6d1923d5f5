"""Operators that carry a small state per key from row to row.

The state is one row, one stamp or the persons of one frame. Throttling and tracking hold
rows back until the watermark has passed them and then decide in event-time order, so that
their results do not depend on how the stream is cut into micro-batches; a key without new
rows is woken by an event-time timer. Rows behind the watermark are dropped and counted by
the engine (``numRowsDroppedByWatermark`` of the query's progress). What a key holds back is
bounded by its rows within the watermark's delay.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewise.operators.assign import best_matching, best_matchings

TABLE_CELLS = 1 << 18  # that are matched at once
BUCKETS = 1024  # of keys that share one state, where keys may be very many


def _ordered(pdfs: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(pdfs)
    return pd.concat(parts, ignore_index=True).sort_values(by, ignore_index=True)


def with_latest(
    stream: DataFrame, other: DataFrame, key: str, ts: str, row_id: str, value: str,
    max_age: float | None = None,
) -> DataFrame:
    """Each row of ``stream`` with the last row of ``other`` of its key seen before it.

    Rows out: key, ts, row_id, other_id, other_value, age (s). With ``max_age`` an
    older row of ``other`` is not attached. A row of ``other`` that comes late never
    replaces a newer one, and a later row is never attached to an earlier one.
    """
    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select(
            F.col(key).cast("long").alias("key"), F.unix_micros(ts).alias("us"), F.col(row_id).alias("id"),
            F.col(value).cast("double").alias("value"), F.lit(side).alias("side"),
        )

    def step(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        rows = _ordered(pdfs, ["us", "side", "id"])
        for us, rid, val, side in zip(rows["us"], rows["id"], rows["value"], rows["side"]):
            if side == 0:
                if last is None or (us, rid) >= last[:2]:
                    last = (int(us), int(rid), float(val))
                continue
            age = None if last is None else (us - last[0]) / 1e6
            fresh = age is not None and age >= 0 and (max_age is None or age < max_age)
            seen = (last[1], last[2], age) if fresh else (None, None, None)
            out.append((int(k[0]), int(us), int(rid), *seen))
        if last is not None:
            state.update(last)
        if not out:
            return
        names = ["key", "us", "id", "other_id", "other_value", "age"]
        # frames of only missing values are meant here
        warnings.simplefilter("ignore", FutureWarning)
        frame = pd.DataFrame(out, columns=names)
        frame["other_id"] = frame["other_id"].astype("Int64")
        yield frame.astype({"other_value": "float64", "age": "float64"})

    both = tagged(other, 0).unionByName(tagged(stream, 1))
    return both.groupBy("key").applyInPandasWithState(
        step, "key long, us long, id long, other_id long, other_value double, age double",
        "us long, id long, value double", "append", GroupStateTimeout.NoTimeout,
    )


def _waiting(pdfs: Iterator[pd.DataFrame], columns: list[str], kept: tuple) -> pd.DataFrame:
    """The rows held back in the state, one array per column, and the new ones; rows with a
    missing value only move the watermark."""
    held = pd.DataFrame(dict(zip(columns, kept, strict=True)), columns=columns)
    parts = [held, *(p[columns] for p in pdfs if len(p))]
    return pd.concat([p for p in parts if len(p)] or [held], ignore_index=True).dropna()


def _numbers(held: bytes, width: int) -> np.ndarray:
    """Rows of ``width`` whole numbers that a state holds as bytes."""
    return np.frombuffer(held, np.int64).reshape(-1, width)


def _wake(state: GroupState, left: pd.Series | np.ndarray) -> None:
    """A timer for the first row (us) that is still held back."""
    if len(left):
        state.setTimeoutTimestamp(-(-int(left.min()) // 1000))


def throttle_stream(
    stream: DataFrame, key: str, ts: str, row_id: str, spacing: float, watermark: str = "10 seconds"
) -> DataFrame:
    """At most one row per key within ``spacing`` seconds of the last kept row.

    Rows are decided in order of (ts, row_id) once the watermark has passed them, which gives
    the rows of the batch operator, whatever the order within the delay. The last rows of a
    stream wait for a later row of any key, or for `closed`. Rows without stamp or id give none.
    Keys are dealt into ``BUCKETS``, each with one state, as a call per key costs more than its rows.
    """
    gap = int(round(spacing * 1_000_000))
    names = ["none", "key", "us", "id"]  # a NULL key is a key; whole numbers without gaps, so no digit is lost
    us = F.unix_micros(ts)
    rows = stream.withWatermark(ts, watermark).select(
        F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BUCKETS)).alias("bucket"),
        F.col(key).isNull().cast("long").alias("none"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"),
        F.coalesce(us, F.lit(0)).alias("us"), F.coalesce(F.col(row_id).cast("long"), F.lit(0)).alias("id"),
        (us.isNotNull() & F.col(row_id).isNotNull()).alias("whole"), ts,
    )

    def step(bucket, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, held = state.get if state.exists else (b"", b"")
        last = {(none, k): at for none, k, at in _numbers(known, 3).tolist()}
        new = (p.loc[p["whole"].astype(bool), names].to_numpy(np.int64) for p in pdfs)
        part = np.concatenate([_numbers(held, 4), *new])
        part = part[np.lexsort((part[:, 3], part[:, 2], part[:, 1], part[:, 0]))]
        final = part[:, 2] <= state.getCurrentWatermarkMs() * 1000
        now, left = part[final], part[~final]
        keep = np.zeros(len(now), dtype=bool)
        for i, (none, k, at, _) in enumerate(now.tolist()):
            before = last.get((none, k))
            if before is None or at - before > gap:
                keep[i], last[none, k] = True, at
        if last or len(left):
            state.update((np.array([(*k, at) for k, at in last.items()], np.int64).tobytes(), left.tobytes()))
        _wake(state, left[:, 2])
        out = now[keep]
        keys = pd.Series(out[:, 1], dtype="Int64").mask(pd.Series(out[:, 0], dtype="bool"))
        yield pd.DataFrame({"key": keys, "us": out[:, 2], "id": out[:, 3]})

    return rows.groupBy("bucket").applyInPandasWithState(
        step, "key long, us long, id long", "known binary, held binary", "append", GroupStateTimeout.EventTimeTimeout,
    )


def stale_feedback(
    frames: DataFrame, feedback: DataFrame, key: str, ts: str, row_id: str, value: str,
    max_age: float,
) -> DataFrame:
    """Frames with usable feedback; negative or too large ages are dropped.

    A frame without it has NULLs; `missing_feedback` reports them.
    """
    return with_latest(frames, feedback, key, ts, row_id, value, max_age)


def missing_feedback(
    stream: DataFrame, key: str, ts: str, row_id: str, is_frame: Column, max_age: float, every: float = 1.0,
    watermark: str = "10 seconds",
) -> DataFrame:
    """Frames whose feedback is missing or too old, reported at most once per key within ``every`` seconds.

    ``stream`` holds frames and feedback, told apart by ``is_frame``; feedback of the same stamp counts.
    Rows out: key, us, id, ``missed`` (frames without feedback since the report before, this one included)
    and the ``age`` of the last feedback in seconds, NULL if there was none. Rows are decided in order of
    (ts, feedback first, row_id) once the watermark has passed them; those without stamp, id or kind only
    move the watermark.
    """
    gap, limit = int(round(every * 1_000_000)), int(round(max_age * 1_000_000))
    names = ["us", "kind", "id"]
    rows = stream.withWatermark(ts, watermark).select(
        F.col(key).cast("long").alias("key"), F.unix_micros(ts).alias("us"), is_frame.cast("long").alias("kind"),
        F.col(row_id).cast("long").alias("id"), ts,
    )

    def step(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, told, missed, *kept = state.get if state.exists else (None, None, 0, [], [], [])
        part = _waiting(pdfs, names, tuple(kept)).astype("int64").sort_values(names, ignore_index=True)
        final = part["us"] <= state.getCurrentWatermarkMs() * 1000
        left, out = part[~final], []
        for us, kind, rid in part.loc[final, names].itertuples(index=False, name=None):
            if not kind:
                seen = us
            elif seen is None or us - seen >= limit:
                missed += 1
                if told is None or us - told > gap:
                    out.append((us, rid, missed, None if seen is None else (us - seen) / 1e6))
                    told, missed = us, 0
        if seen is not None or missed or told is not None or len(left):
            state.update((seen, told, missed, *(left[c].tolist() for c in names)))
        _wake(state, left["us"])
        frame = pd.DataFrame(out, columns=["us", "id", "missed", "age"]).assign(key=k[0])
        yield frame.astype({"key": "Int64", "us": "int64", "id": "int64", "missed": "int64", "age": "float64"})[
            ["key", "us", "id", "missed", "age"]
        ]

    return rows.groupBy("key").applyInPandasWithState(
        step, "key long, us long, id long, missed long, age double",
        "seen long, told long, missed long, us array<long>, kind array<long>, id array<long>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def _iou_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.maximum(a[..., :, None, :2], b[..., None, :, :2])
    high = np.minimum(a[..., :, None, 2:], b[..., None, :, 2:])
    inter = np.prod(np.clip(high - low, 0, None), axis=-1)
    size_a, size_b = np.prod(a[..., 2:] - a[..., :2], axis=-1), np.prod(b[..., 2:] - b[..., :2], axis=-1)
    return inter / (size_a[..., :, None] + size_b[..., None, :] - inter + np.finfo(float).eps)


def _wider(boxes: np.ndarray, k: float) -> np.ndarray:
    side = (boxes[..., 2:] - boxes[..., :2]) * k
    return boxes + np.concatenate([side, side], axis=-1) * np.array([-1, -1, 1, 1])


def _followed(boxes: np.ndarray, sizes: np.ndarray, k: float, min_iou: float) -> np.ndarray:
    """For each box the place of its match in the frame before, or -1; ``sizes`` are the numbers of boxes to a frame."""
    starts, link = np.cumsum(sizes) - sizes, np.full(len(boxes), -1)
    shapes = sizes[:-1] * (int(sizes.max()) + 1) + sizes[1:]
    for shape in np.unique(shapes[(sizes[:-1] > 0) & (sizes[1:] > 0)]):
        m, n = divmod(int(shape), int(sizes.max()) + 1)
        pairs = np.flatnonzero(shapes == shape)
        for at in np.array_split(pairs, -(-len(pairs) * m * n // TABLE_CELLS)):
            known, now = starts[at][:, None] + np.arange(m), starts[at + 1][:, None] + np.arange(n)
            gain = _iou_table(_wider(boxes[known], k), boxes[now])
            if len(at) == 1:
                i, j = np.array(best_matching(gain[0])).T
                t = np.zeros(len(i), dtype=np.int64)
            else:
                of = best_matchings(gain)
                t, i = np.nonzero(of >= 0)
                j = of[t, i]
            good = gain[t, i, j] > min_iou
            link[now[t[good], j[good]]] = known[t[good], i[good]]
    return link


def track(
    stream: DataFrame, key: str, frame: str, det_id: str, min_iou: float = 0.0,
    grow: float = 1.25, ts: str | None = None, watermark: str = "10 seconds", patience: int = 0,
) -> DataFrame:
    """Persons carried from frame to frame: matched ones keep their track number.

    A frame is closed when the watermark passes it: rows of one frame may come in several
    micro-batches, and frames in any order within the delay. All rows of a frame carry its
    stamp ``ts``; without one the frame numbers are the seconds of the clock, frame 0 at second 1.

    The persons of a frame are matched to the known ones at least cost 1 - IoU, the earlier
    boxes enlarged by ``grow``; pairs with IoU <= ``min_iou`` do not count. New persons get new
    numbers; a person without a match is known for ``patience`` further frames of its camera.
    Rows in are (key, frame, det_id, box); rows out key, frame, det_id, track, age (frames in
    which the track was seen). The last frames wait for a later one of any camera, or for
    `closed`. Rows with a missing value give none.
    """
    box = ["xmin", "ymin", "xmax", "ymax"]
    names = ["us", "frame", "det_id", *box]
    if ts is None:
        ts = "_ts"
        stream = stream.withColumn(ts, F.timestamp_seconds(F.col(frame).cast("long") + 1))
    rows = stream.withWatermark(ts, watermark).select(
        F.col(key).cast("long").alias("key"), F.col(frame).cast("long").alias("frame"),
        F.col(det_id).cast("long").alias("det_id"), *(F.col(c).cast("double").alias(c) for c in box),
        F.unix_micros(ts).alias("us"), ts,
    )
    k = (grow - 1.0) / 2.0

    def step(name, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (0, [], [], [], [], b"", b"")
        following, ids, ages, missed, flat = old[0], *(list(v) for v in old[1:5])
        numbers, sides = _numbers(old[5], 3), np.frombuffer(old[6]).reshape(-1, 4)
        kept = (*(numbers[:, i] for i in range(3)), *(sides[:, i] for i in range(4)))
        part = _waiting(pdfs, names, kept)
        part = part.astype({"us": "int64", "frame": "int64", "det_id": "int64"})
        part = part.sort_values(["us", "frame", "det_id"], ignore_index=True)
        final = part["us"] <= state.getCurrentWatermarkMs() * 1000
        done, left = part[final], part[~final]
        frames = done["frame"].to_numpy()
        boxes = done[box].to_numpy(dtype=float)
        tracks, lived = np.zeros(len(done), dtype=np.int64), np.zeros(len(done), dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]]) if len(done) else []
        for a, b in zip(starts, np.r_[starts[1:], len(done)].astype(int) if len(done) else []) if patience > 0 else ():
            now = boxes[a:b]
            taken = np.full(b - a, -1)
            before = np.array(flat, dtype=float).reshape(-1, 4)
            if ids:
                gain = _iou_table(_wider(before, k), now)
                for i, j in best_matching(gain):
                    if gain[i, j] > min_iou:
                        taken[j] = i
            for j in range(b - a):
                if taken[j] >= 0:
                    tracks[a + j], lived[a + j] = ids[taken[j]], ages[taken[j]] + 1
                else:
                    tracks[a + j], lived[a + j] = following, 1
                    following += 1
            seen = set(taken.tolist())
            lost = [i for i in range(len(ids)) if i not in seen and missed[i] < patience]
            missed = [0] * (b - a) + [missed[i] + 1 for i in lost]
            ids = tracks[a:b].tolist() + [ids[i] for i in lost]
            ages = lived[a:b].tolist() + [ages[i] for i in lost]
            flat = np.concatenate([now, before[lost]]).ravel().tolist()
        if patience <= 0 and len(done):
            # only the frame before counts, so all frames are matched at once
            ends = np.r_[starts[1:], len(done)]
            before = np.array(flat, dtype=float).reshape(-1, 4)
            link = _followed(np.concatenate([before, boxes]), np.r_[len(before), ends - starts], k, min_iou)
            for place in link[len(before) :].tolist():
                ids.append(following if place < 0 else ids[place])
                ages.append(1 if place < 0 else ages[place] + 1)
                following += place < 0
            tracks, lived = np.array(ids[len(before) :]), np.array(ages[len(before) :])
            last = starts[-1]
            ids, ages, missed = tracks[last:].tolist(), lived[last:].tolist(), [0] * (len(done) - last)
            flat = boxes[last:].ravel().tolist()
        if ids or len(left):
            held = left[names[:3]].to_numpy(np.int64).tobytes(), left[box].to_numpy(np.float64).tobytes()
            state.update((following, ids, ages, missed, flat, *held))
        _wake(state, left["us"])
        out = done[["frame", "det_id"]].assign(key=name[0], track=tracks, age=lived).astype({"key": "Int64"})
        yield out[["key", "frame", "det_id", "track", "age"]]

    return rows.groupBy("key").applyInPandasWithState(
        step, "key long, frame long, det_id long, track long, age long",
        "following long, ids array<long>, ages array<long>, missed array<long>, boxes array<double>, "
        "numbers binary, sides binary", "append", GroupStateTimeout.EventTimeTimeout,
    )


def persons_to_detections(persons: DataFrame, threshold: float, grow: float = 1.25) -> DataFrame:
    """Between detector runs the visible persons of the last frame, enlarged, are the detections.

    Rows need n_valid, n_occluded, conf and the box; label 1 is the person class.
    """
    from framewise.functions import boxes as B
    from framewise.functions.boxes import Box

    seen = persons.filter(
        (F.col("n_valid") - F.col("n_occluded") > 0) & (F.col("conf") > threshold)
    )
    kept = [c for c in seen.columns if c not in (*Box._fields, "conf", "n_valid", "n_occluded")]
    return seen.select(
        *kept, F.lit(1).alias("label"), F.col("conf").alias("score"),
        *B.enlarge(Box.of(), grow).columns(),
    )
