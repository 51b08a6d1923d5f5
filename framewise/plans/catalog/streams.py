"""Streaming queries (S2, T1-T9): the driver tables are fed as streams until drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.boxes import Box
from framewise.plans.catalog.columns import _PERSON_SQL, person_table
from framewise.plans.catalog.matching import _asof_cols, _asof_sql, _hourly_sql, hourly
from framewise.plans.registry import query, r, rs
from framewise.plans.views import Tables
from framewise.session import scratch_path
from framewise.streaming import stateful, topics


def feed(t: Tables, df: DataFrame, name: str, files: int = 4) -> str:
    """``df`` as a folder of files a stream can read."""
    path = scratch_path(t.spark, name)
    df.repartition(files).write.parquet(path)
    return path


def live(t: Tables, df: DataFrame, name: str, files: int = 4) -> DataFrame:
    return topics.stream_topic(t.spark, feed(t, df, name, files), df.schema)


def by_time(t: Tables, df: DataFrame, slices: int = 4, close_after: float | None = None) -> DataFrame:
    """``df`` as a stream in event-time order, several micro-batches long."""
    return topics.replay_stream(t.spark, df, slices=slices, close_after=close_after).withColumn("ts", F.col("ts").cast("timestamp"))


def events(t: Tables, name: str) -> DataFrame:
    return t.v_events.filter(F.col("topic") == name)


@query("s2_stream_topic", f"SELECT event_id, {rs('value')} AS value FROM v_events WHERE topic = 'click'", ("v_events",))
def _(t: Tables) -> DataFrame:
    rows = t.v_events
    stream = topics.stream_topic(t.spark, feed(t, rows, "topic"), rows.schema, topic="click", files_per_batch=2)
    return topics.drain(stream.select("event_id", "value"), "s2").select("event_id", r(F.col("value")).alias("value"))


_WEEK = 7 * 86_400


@query(
    "t1_latest_only",
    f"""SELECT topic, camera, event_id FROM (SELECT *, row_number() OVER (PARTITION BY topic, camera, epoch_us(ts) // {_WEEK * 1_000_000}
      ORDER BY ts DESC, event_id DESC) AS k FROM v_events) WHERE k = 1""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    # a micro-batch for each week, so that what waits together is known
    stream = topics.replay_stream(t.spark, t.v_events, every=_WEEK).withColumn("ts", F.col("ts").cast("timestamp"))
    out = topics.drain_batches(
        stream, "t1", lambda b: topics.latest_only(b, ["topic", "camera"], "ts", "event_id"), stream.schema
    )
    return out.select("topic", "camera", "event_id")


@query(
    "t2_sync_stream",
    f"WITH {_hourly_sql('click', 'c')}, {_hourly_sql('view', 'd')} SELECT c.camera, epoch_us(c.h) AS us, c_id, d_id FROM c JOIN d USING (camera, h)",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    streams = [live(t, hourly(t, n, p), n, 2) for n, p in (("click", "c"), ("view", "d"))]
    # the files are not in time order, so the bound covers the whole log
    out = topics.sync_stream(streams, "camera", "ts", "60 days")
    return topics.drain(out.select("camera", F.unix_micros("ts").alias("us"), "c_id", "d_id"), "t2")


def _both(t: Tables, max_age: float | None) -> DataFrame:
    """Clicks with the latest view, from one ordered stream of both topics."""
    both = by_time(t, t.v_events.filter("topic in ('click', 'view')"))
    if max_age is None:
        out = stateful.with_latest(
            both.filter("topic = 'click'"), both.filter("topic = 'view'"), "camera", "ts", "event_id", "value"
        )
    else:
        out = stateful.stale_feedback(
            both.filter("topic = 'click'"), both.filter("topic = 'view'"), "camera", "ts", "event_id", "value", max_age
        )
    done = topics.drain(out, "latest")
    return done.select(
        F.col("id").alias("event_id"), F.col("other_id").alias("b_event_id"),
        r(F.col("other_value")).alias("b_value"), r(F.col("age")).alias("age"),
    )


@query("t3_latest_value_state", _asof_sql(_asof_cols("true")), ("v_events",))
def _(t: Tables) -> DataFrame:
    return _both(t, None)


@query("t6_stale_feedback", _asof_sql(_asof_cols("age >= 0 AND age < 3600")), ("v_events",))
def _(t: Tables) -> DataFrame:
    return _both(t, 3600.0)


@query(
    "t6_missing_feedback",
    f"""WITH RECURSIVE m AS (SELECT c.camera, c.event_id, c.us,
      (SELECT max(v.us) FROM v_events v WHERE v.topic = 'view' AND v.camera = c.camera AND v.us <= c.us) AS seen
      FROM v_events c WHERE c.topic = 'click'),
    o AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY us, event_id) AS k FROM m WHERE seen IS NULL OR us - seen >= 3600000000),
    s AS (SELECT camera, k, event_id, seen, us, us AS last, true AS keep FROM o WHERE k = 1
      UNION ALL SELECT o.camera, o.k, o.event_id, o.seen, o.us, CASE WHEN o.us - s.last > 14400000000 THEN o.us ELSE s.last END,
      o.us - s.last > 14400000000 FROM s JOIN o ON o.camera = s.camera AND o.k = s.k + 1)
    SELECT event_id, k - coalesce(lag(k) OVER (PARTITION BY camera ORDER BY k), 0) AS missed, {rs('(us - seen) / 1e6')} AS age
    FROM s WHERE keep""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    both = by_time(t, t.v_events.filter("topic in ('click', 'view')"), close_after=60.0)
    frames = F.col("topic") == "click"
    out = topics.drain(stateful.missing_feedback(both, "camera", "ts", "event_id", frames, 3600.0, 14400.0), "missing")
    return out.select(F.col("id").alias("event_id"), "missed", r(F.col("age")).alias("age"))


@query("t4_track_stream")
def _(t: Tables) -> DataFrame:
    # frame numbers are the clock, from 1 as a stream takes nothing at its first watermark, 0
    det = t.v_det.select((F.col("frame") % 16).alias("camera"), "frame", "det_id", *Box._fields)
    det = det.withColumn("ts", F.timestamp_seconds(F.col("frame") + 1))
    stream = topics.replay_stream(t.spark, det, slices=4, close_after=60.0)
    out = topics.drain(stateful.track(stream, "camera", "frame", "det_id", min_iou=0.1, ts="ts"), "t4")
    return out.select("key", "frame", "det_id", "track", "age")


_HULL = ", ".join(
    f"{rs(f'{n} {s} 0.125e0 * ({hi} - {lo})')} AS {n}"
    for n, s, lo, hi in (
        ("xmin", "-", "xmin", "xmax"), ("ymin", "-", "ymin", "ymax"), ("xmax", "+", "xmin", "xmax"), ("ymax", "+", "ymin", "ymax"),
    )
)


@query(
    "t5_reuse_detections",
    f"""WITH {_PERSON_SQL}, b AS (SELECT person, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM v_kp WHERE conf > 0 GROUP BY 1)
    SELECT person, 1 AS label, {rs('conf')} AS score, {_HULL} FROM p JOIN b USING (person) WHERE n_valid - n_occluded > 0 AND conf > 0.1e0""",
    ("v_kp",),
)
def _(t: Tables) -> DataFrame:
    hull = t.v_kp.filter("conf > 0").groupBy("person").agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")
    )
    stream = live(t, person_table(t).join(hull, "person"), "persons", 2)
    out = topics.drain(stateful.persons_to_detections(stream, 0.1), "t5")
    return out.select("person", "label", r(F.col("score")).alias("score"), *(r(F.col(c)).alias(c) for c in Box._fields))


@query(
    "t7_session_stream",
    """WITH g AS (SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS d FROM v_events),
    s AS (SELECT user_id, us, sum(CASE WHEN d IS NULL OR d >= 18000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g)
    SELECT user_id, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s GROUP BY user_id, k""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    rows = t.v_events.select("user_id", "ts")
    # one late row per user closes the last real sessions; it stays open itself
    late = rows.select("user_id").distinct().select("user_id", F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    stream = by_time(t, rows.unionByName(late))
    out = topics.drain(topics.sessions(stream, "user_id", "ts", "18000 seconds", "10 minutes"), "t7")
    closed = out.filter(F.col("first_ts") < "2100-01-01")
    return closed.select(
        "user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n"
    )


@query("t8_replay_stream", f"SELECT event_id, topic, us, {rs('value')} AS value FROM v_events", ("v_events",))
def _(t: Tables) -> DataFrame:
    out = topics.drain(by_time(t, t.v_events, slices=6), "t8")
    return out.select("event_id", "topic", "us", r(F.col("value")).alias("value"))


@query(
    "t9_live_parameters",
    f"SELECT event_id, {rs('value * n_regionkey')} AS weighted FROM v_events JOIN nation ON n_nationkey = camera", ("v_events",),
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "params")
    t.nation.select(F.col("n_nationkey").cast("long").alias("camera"), F.col("n_regionkey").alias("weight")).write.parquet(path)
    out = topics.drain_batches(
        by_time(t, t.v_events), "t9",
        lambda b: topics.with_params(b, path, "camera").select("event_id", (F.col("value") * F.col("weight")).alias("weighted")),
        "event_id long, weighted double",
    )
    return out.select("event_id", r(F.col("weighted")).alias("weighted"))


@query(
    "f8_throttle_stream",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM v_events),
    s AS (SELECT user_id, k, event_id, us AS last, true AS keep FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN o.us - s.last > 14400000000 THEN o.us ELSE s.last END, o.us - s.last > 14400000000
      FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
    SELECT event_id FROM s WHERE keep""",
    ("v_events",),
)
def _(t: Tables) -> DataFrame:
    out = stateful.throttle_stream(by_time(t, t.v_events, close_after=60.0), "user_id", "ts", "event_id", 14400.0)
    return topics.drain(out, "throttle").select(F.col("id").alias("event_id"))
