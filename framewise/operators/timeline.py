"""Operators along event time: as-of joins, gaps, sequences, spacing.

Each takes ``chunk`` seconds: a key's time line is cut into chunks that are
worked on independently, with a small per-chunk carry between them, so one busy
key spreads over many tasks. The chunk length changes the cost, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators.scale import join_on, map_groups, ranked, running

MICROS = 1_000_000


def micros(ts: str | Column) -> Column:
    """Event time in microseconds; TIMESTAMP_NTZ counts as UTC."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two microsecond counts, in seconds."""
    return (later - earlier) / float(MICROS)


def _chunk(us: Column, chunk: float) -> Column:
    return F.floor(us / F.lit(float(chunk * MICROS)))


def timed(df: DataFrame, ts: str, chunk: float) -> DataFrame:
    return df.withColumn("_us", micros(ts)).withColumn("_chunk", _chunk(F.col("_us"), chunk))


# ---------------------------------------------------------------- joins by time


def sync_exact(streams: Sequence[DataFrame], key: str, ts: str) -> DataFrame:
    """Rows of all streams that share key and stamp. Streams must not share other columns.

    Streaming inputs need a watermark on ``ts``; it replaces the bounded queue.
    """
    out = streams[0]
    for other in streams[1:]:
        out = out.join(other, [key, ts])
    return out


def asof(
    a: DataFrame, b: DataFrame, key: str, ts: str, columns: Sequence[str],
    max_age: float | None = None, max_lead: float = 0.0, tie: str | None = None,
    chunk: float = 86400.0, prefix: str = "b_",
) -> DataFrame:
    """Each row of ``a`` with the latest row of ``b`` at or before its stamp.

    ``max_lead`` lets ``b`` be that many seconds ahead, ``max_age`` rejects older
    ones (the row of ``a`` stays, with NULLs). Adds ``<prefix>ts``, ``<prefix>age``
    (seconds) and the prefixed ``columns``. ``tie`` orders rows of ``b`` with one stamp.
    """
    rest = [c for c in columns if c != tie]
    payload = F.struct(
        F.col("_us"),
        *([F.col(tie).alias("_tie")] if tie else []),
        F.col(ts).alias(f"{prefix}ts"),
        *(F.col(c).alias(prefix + c) for c in rest),
    )
    lead = int(round(max_lead * MICROS))
    right = b.select("*", micros(ts).alias("_us")).select(
        F.col(key).alias("_key"), (F.col("_us") - lead).alias("_at"), F.lit(0).alias("_side"),
        F.lit(None).cast(a.schema).alias("_a"), payload.alias("_b"),
    )
    left = a.select(
        F.col(key).alias("_key"), micros(ts).alias("_at"), F.lit(1).alias("_side"),
        F.struct(*a.columns).alias("_a"), F.lit(None).cast(right.schema["_b"].dataType).alias("_b"),
    )
    both = left.unionByName(right).withColumn("_chunk", _chunk(F.col("_at"), chunk))
    seen = running(
        both, ["_key"], ["_at", "_side"], {"_last": ("max", F.col("_b"))}, bucket="_chunk"
    ).filter(F.col("_side") == 1)
    age = seconds_between(F.col("_at"), F.col("_last._us"))
    fresh = F.lit(True) if max_age is None else (age >= -max_lead) & (age < max_age)
    names = [f"{prefix}ts", *(prefix + c for c in rest)]
    picked = [F.when(fresh, F.col(f"_last.{n}")).alias(n) for n in names]
    if tie and tie in columns:
        picked.append(F.when(fresh, F.col("_last._tie")).alias(prefix + tie))
    return seen.select("_a.*", F.when(fresh, age).alias(f"{prefix}age"), *picked)


# ------------------------------------------------------------- gaps and sequences


def with_gap(
    df: DataFrame, key: str, ts: str, tie: str | None = None, chunk: float = 86400.0
) -> DataFrame:
    """Seconds since the previous row of the key, NULL on the first; keeps ``_us``, ``_chunk``."""
    order = ["_us"] + ([tie] if tie else [])
    out = running(
        timed(df, ts, chunk), [key], order, {"_before": ("max", F.col("_us"))},
        bucket="_chunk", before=True,
    )
    return out.withColumn("gap", seconds_between(F.col("_us"), F.col("_before"))).drop("_before")


def split_sequences(
    df: DataFrame, key: str, ts: str, gap: float = 0.300, rate: float = 10.0,
    min_steps: int = 10, tie: str | None = None, chunk: float = 86400.0,
) -> DataFrame:
    """Number the sequences of a key; a longer gap than ``gap`` starts a new one.

    ``step`` counts in units of 1 / rate from the start of the sequence. The first
    row of a sequence tells in ``ended_short`` whether the one before had fewer
    than ``min_steps`` steps up to this row.
    """
    order = ["_us"] + ([tie] if tie else [])
    base = with_gap(df, key, ts, tie, chunk)
    fresh = F.col("gap").isNull() | (F.col("gap") > gap)
    base = base.withColumn("_new", fresh)
    start = F.when(F.col("_new"), F.col("_us"))
    out = running(
        base, [key], order,
        {"sequence": ("sum", F.col("_new").cast("long")), "_start": ("max", start)},
        bucket="_chunk",
    )
    out = running(out, [key], order, {"_old": ("max", start)}, bucket="_chunk", before=True)
    steps = F.rint(seconds_between(F.col("_us"), F.col("_start")) * rate).cast("long")
    old = F.rint(seconds_between(F.col("_us"), F.col("_old")) * rate).cast("long")
    return (
        out.withColumn("sequence", F.col("sequence") - 1)
        .withColumn("step", steps)
        .withColumn("ended_short", F.when(F.col("_new"), old < min_steps))
        .drop("_new", "_start", "_old", "_us", "_chunk")
    )


def missed_frames(
    df: DataFrame, key: str, ts: str, gap: float = 0.120, new_after: float = 0.300,
    rate: float = 10.0, tie: str | None = None, chunk: float = 86400.0,
) -> DataFrame:
    """Frames lost before each row whose gap is long but still inside the sequence."""
    out = with_gap(df, key, ts, tie, chunk)
    lost = F.rint(F.col("gap") * rate - 1.0).cast("long")
    inside = (F.col("gap") > gap) & (F.col("gap") <= new_after)
    return out.withColumn("missed", F.when(inside, lost).otherwise(F.lit(0))).drop("_us", "_chunk")


def moving_rate(
    df: DataFrame, key: str, ts: str, n: int, tie: str | None = None, chunk: float = 86400.0
) -> DataFrame:
    """Rows per second over the last ``n`` intervals; 0 on the first row of a key."""
    order = ["_us"] + ([tie] if tie else [])
    rows = ranked(timed(df, ts, chunk), [key], order, "_rn", bucket="_chunk")
    back = rows.select(
        F.col(key).alias("_k"), (F.col("_rn") + n).alias("_rn2"), F.col("_us").alias("_then")
    )
    first = df.groupBy(F.col(key).alias("_k1")).agg(F.min(micros(ts)).alias("_first"))
    # equi joins on (key, position): a busy key spreads by position
    out = rows.join(
        back, rows[key].eqNullSafe(back["_k"]) & (rows["_rn"] == back["_rn2"]), "left"
    ).join(first, F.col(key).eqNullSafe(F.col("_k1")), "left")
    count = F.least(F.col("_rn") - 1, F.lit(n))
    span = seconds_between(F.col("_us"), F.coalesce("_then", "_first"))
    rate = F.when(F.col("_rn") == 1, F.lit(0.0)).otherwise(F.try_divide(count.cast("double"), span))
    return out.withColumn("rate", rate).drop(
        "_us", "_chunk", "_rn", "_k", "_rn2", "_then", "_k1", "_first"
    )


def every_nth(
    df: DataFrame, key: str, ts: str, n: int, tie: str | None = None, chunk: float = 86400.0
) -> DataFrame:
    """Rows 0, n, 2 n, ... of each key in time order."""
    order = ["_us"] + ([tie] if tie else [])
    rows = ranked(timed(df, ts, chunk), [key], order, "_rn", bucket="_chunk")
    return rows.filter((F.col("_rn") - 1) % n == 0).drop("_rn", "_us", "_chunk")


# --------------------------------------------------------------- minimum spacing

SHORT = 10_000  # rows of a segment that is walked in one go


def _chain_exits(spacing: int):
    """Per piece of a time line: where a walk leaves it, for every row it may enter at."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us")
        t = np.unique(pdf["_us"].to_numpy())
        follow = np.searchsorted(t, t + spacing, side="right")
        leave = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if follow[i] < len(t):
                leave[i] = leave[follow[i]]
        # an earlier piece ends before t[0], so entry is at most one spacing later
        last = 1 if pdf["_anchor"].iloc[0] else int(np.searchsorted(t, t[0] + spacing, "right")) + 1
        part = slice(0, last)
        return pd.DataFrame(
            {
                "_key": pdf["_key"].iloc[0],
                "_seg": pdf["_seg"].iloc[0],
                "_chunk": pdf["_chunk"].iloc[0],
                "_in": t[part],
                "_out": leave[part],
            }
        )

    return run


def _chain_pieces(spacing: int):
    """Follow one segment through its pieces; yields where each piece is entered."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_chunk", "_in"])
        chunks, t, leave = (pdf[c].to_numpy() for c in ("_chunk", "_in", "_out"))
        starts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
        entries, last = [], None
        for a, b in zip(starts, np.r_[starts[1:], len(t)]):
            i = a if last is None else a + int(np.searchsorted(t[a:b], last + spacing, "right"))
            if i < b:
                entries.append((pdf["_key"].iloc[0], pdf["_seg"].iloc[0], chunks[a], t[i]))
                last = leave[i]
        return pd.DataFrame(entries, columns=["_key", "_seg", "_chunk", "_entry"])

    return run


def _walk(spacing: int):
    """Rows kept in a piece, from its entry on; rows arrive sorted by piece and time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, due = None, 0
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            names = zip(pdf["_key"], pdf["_seg"], pdf["_chunk"])
            for i, (name, us, entry) in enumerate(zip(names, pdf["_us"], pdf["_entry"])):
                if name != piece:
                    piece, due = name, entry
                if us >= due:
                    keep[i] = True
                    due = us + spacing + 1
            yield pdf.loc[keep, ["_key", "_seg", "_us"]]

    return run


def keep_spaced(
    df: DataFrame, key: str, ts: str, spacing: float, tie: str | None = None,
    chunk: float = 86400.0, force: Column | None = None,
) -> DataFrame:
    """Greedy thinning: keep a row when it is more than ``spacing`` after the last kept one.

    A row after a long gap is always kept, and so starts a segment that does not
    depend on earlier ones; rows where ``force`` holds do too. Segments of one row
    need no more work, those of up to ``SHORT`` rows are walked from their start. Longer
    ones are cut by time into pieces: each piece reports where a walk entering at its first rows would leave it, the pieces of a segment
    are chained by these reports, and then all pieces are walked in parallel.
    """
    us = int(round(spacing * MICROS))
    order = ["_us"] + ([tie] if tie else [])
    base = timed(df, ts, chunk)
    if force is not None:
        base = base.withColumn("_force", force)
    # rows of one stamp: only the first can be kept, unless forced
    base = running(base, [key], order, {"_before": ("max", F.col("_us"))}, "_chunk", before=True)
    anchor = F.col("_before").isNull() | (F.col("_us") - F.col("_before") > us)
    if force is not None:
        anchor = anchor | F.coalesce(F.col("_force"), F.lit(False))
    base = base.withColumn("_anchor", anchor)
    base = running(
        base, [key], order, {"_seg": ("sum", F.col("_anchor").cast("long"))}, bucket="_chunk"
    ).withColumn("_key", F.col(key).cast("string"))
    base = join_on(
        base, base.groupBy("_key", "_seg").agg(F.count(F.lit(1)).alias("_n")), ["_key", "_seg"]
    )
    extra = ["_us", "_chunk", "_before", "_anchor", "_seg", "_key", "_n"]
    extra += ["_force"] if force is not None else []
    single = base.filter(F.col("_n") == 1)
    many = base.filter(F.col("_n") > 1)

    piece = ["_key", "_seg", "_chunk"]
    # a short segment is one piece, entered at its start
    start = F.lit(-(1 << 63)).cast("long").alias("_entry")
    short = many.filter(F.col("_n") <= SHORT).select("_key", "_seg", F.lit(0).cast("long").alias("_chunk"), "_us", start)
    # the first row of a stamp stands for the stamp
    stamps = many.filter(F.col("_n") > SHORT).groupBy(*piece, "_us").agg(F.max("_anchor").alias("_anchor"))
    exits = map_groups(
        stamps, piece, _chain_exits(us), "_key string, _seg long, _chunk long, _in long, _out long"
    )
    entries = map_groups(
        exits, ["_key", "_seg"], _chain_pieces(us), "_key string, _seg long, _chunk long, _entry long"
    )
    walked = (
        join_on(stamps, entries, piece, "inner")
        .select(*piece, "_us", "_entry")
        .unionByName(short)
        .repartition(*piece)
        .sortWithinPartitions(*piece, "_us")
        .mapInPandas(_walk(us), "_key string, _seg long, _us long")
    )
    # of rows with a kept stamp the anchor comes first in a segment; else the smallest tie
    chosen = join_on(many, walked, ["_key", "_seg", "_us"], "inner")
    first = Window.partitionBy("_key", "_seg", "_us").orderBy(*(F.col(c) for c in order))
    chosen = chosen.withColumn("_first", F.row_number().over(first)).filter("_first = 1")
    return single.unionByName(chosen.drop("_first")).drop(*extra)


def schedule(
    df: DataFrame, key: str, ts: str, gap: float, active: str | None = None,
    tie: str | None = None, chunk: float = 86400.0,
) -> DataFrame:
    """Frames on which a detector runs: gap since its last run, or nobody active."""
    force = (F.col(active) == 0) if active else None
    return keep_spaced(df, key, ts, gap, tie, chunk, force)
