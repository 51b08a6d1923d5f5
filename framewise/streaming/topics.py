"""Streams from and to topics; joins, sessions and parameters that need no state of their own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewise.operators.aggregate import topk
from framewise.operators.scale import _below
from framewise.session import scratch_path


ROWS_OF_A_WRITER = 50_000


def stream_topic(
    spark: SparkSession, path: str, schema: StructType | str, topic: str | None = None,
    ts: str = "ts", files_per_batch: int | None = None, fmt: str = "parquet", **options: str,
) -> DataFrame:
    """A topic as a stream: a folder of files, or another source by ``fmt`` and options."""
    reader = spark.readStream.format(fmt).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "parquet":
        reader = reader.schema(schema)
    rows = reader.load(path)
    if topic is not None:
        rows = rows.filter(F.col("topic") == topic)
    # watermarks need a zoned timestamp
    return rows.withColumn(ts, F.col(ts).cast("timestamp")) if ts in rows.columns else rows


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read its output back from the shared folder."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", marks)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(
    stream: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], schema: StructType | str
) -> DataFrame:
    """Run ``step`` on every micro-batch; a batch that is repeated replaces its own output."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", marks)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


def replay_stream(
    spark: SparkSession, log: DataFrame, ts: str = "ts", slices: int = 8, every: float | None = None,
    rows_per_file: int = 1_000_000, close_after: float | None = None, rows_per_slice: int = 2_000_000,
) -> DataFrame:
    """A recorded log fed in bounded batches in event-time order.

    With ``close_after`` a last slice holds the one row of `closed`, that many seconds after the log.

    The log is cut into ``slices`` time ranges of about equal size, more where one would hold over
    ``rows_per_slice`` rows, as states hold back the rows of a micro-batch, or at all multiples of
    ``every`` seconds. Each is written on its own, so that the file source, which goes by
    modification time, takes them oldest first. Every slice has the same number of files,
    which many tasks write, and makes one micro-batch; the number is such that the smallest
    slice fills them all.
    """
    path = scratch_path(spark, "replay")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    if every is None:
        rows = log.count()
        slices = max(slices, -(-rows // rows_per_slice))
        # a stamp for every slice
        cuts = log.agg(F.percentile_approx(us, [i / slices for i in range(1, slices)])).first()[0] or []
        smallest = rows // (2 * slices)
    else:
        step = int(every * 1_000_000)
        sizes = {r["s"]: r["count"] for r in log.groupBy(F.floor(us / step).alias("s")).count().collect()}
        cuts = [s * step for s in sorted(sizes)[1:]]
        smallest = min(sizes.values(), default=0)
    # a slice is written by all cores if it has the rows for it
    files_per_batch = max(1, smallest // rows_per_file, min(spark.sparkContext.defaultParallelism, smallest // ROWS_OF_A_WRITER))
    cuts = sorted(set(cuts))
    number = F.when(F.col("_us").isNotNull(), _below(cuts, "_us", True)) if cuts else F.lit(0)
    # the log is dealt once, so that a slice does not read all of it again
    dealt = f"{path}-dealt"
    rows = log.withColumn("_us", us).withColumn("_slice", number.cast("int"))
    rows = rows.repartition("_slice", F.pmod(F.xxhash64("_us"), F.lit(files_per_batch))).drop("_us")
    rows.write.partitionBy("_slice").parquet(dealt)
    dealt_rows = spark.read.schema(rows.schema).parquet(dealt)
    for n in range(len(cuts) + 1):
        part = dealt_rows.filter(F.col("_slice") == n).drop("_slice")
        part.repartition(files_per_batch).write.parquet(f"{path}/slice-{n:05d}")
    if close_after is not None:
        closed(log, ts, close_after).write.parquet(f"{path}/slice-{len(cuts) + 1:05d}")
    reader = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}/slice-*")


def closed(log: DataFrame, ts: str, after: float) -> DataFrame:
    """One row that ends a recorded log: a stamp ``after`` seconds past its last one, all else NULL.

    It moves the watermark past all rows, so that operators which hold rows back give them out.
    """
    zone = log.schema[ts].dataType
    end = log.agg((F.max(F.col(ts).cast("timestamp")) + F.make_dt_interval(secs=F.lit(float(after)))).alias("_end"))
    return end.select(
        *((F.col("_end") if f.name == ts else F.lit(None)).cast(zone if f.name == ts else f.dataType).alias(f.name)
          for f in log.schema.fields)
    )


def latest_only(batch: DataFrame, key: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Of the waiting messages of a micro-batch only the newest per key."""
    return topk(batch, list(key), [f"-{ts}", f"-{tie}"], 1)


def sync_stream(
    streams: Sequence[DataFrame], key: str, ts: str, watermark: str = "10 seconds"
) -> DataFrame:
    """Rows of all streams with the same key and stamp; the watermark bounds what is kept."""
    marked = [s.withWatermark(ts, watermark) for s in streams]
    out = marked[0]
    for other in marked[1:]:
        out = out.join(other, [key, ts])
    return out


def sessions(stream: DataFrame, key: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """Sequences of a stream: first and last stamp and row count per session."""
    window = F.session_window(ts, gap)
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.col(key), window)
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .drop("session_window")
    )


def with_params(batch: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """Attach the current parameters, re-read from their small table for every micro-batch."""
    from framewise.operators.dims import join_dim

    params = batch.sparkSession.read.parquet(path)
    if key is not None:
        return join_dim(batch, params, [key])
    newest = params.orderBy(F.desc("version")).limit(1)
    return batch.join(F.broadcast(newest))
