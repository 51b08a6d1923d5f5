"""Writers: persons as JSON, topics, per-class files, timing traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def persons_to_json(
    df: DataFrame, frame: Sequence[str], timestamp: Column, crop_info: Column | None = None,
    columns: Sequence[str] = ("keypoints", "score", "id", "bbox"),
) -> DataFrame:
    """One JSON text per frame: timestamp, crop_info and the list of persons by id.

    ``frame`` names one moment of one camera; a frame is one document, so its persons
    meet in one row.
    """
    person = F.struct("id", *(c for c in columns if c != "id"))
    listed = df.groupBy(*frame).agg(
        F.max(timestamp).alias("timestamp"),
        F.max(crop_info if crop_info is not None else F.lit(None).cast("array<double>")).alias("crop_info"),
        F.array_sort(F.collect_list(person)).alias("people"),
    )
    return listed.select(*frame, F.to_json(F.struct("timestamp", "crop_info", "people")).alias("json"))


def write_topic(df: DataFrame, path: str, topic: str | None = None, active: bool = True) -> bool:
    """Append rows below ``camera`` / ``topic`` folders; nothing happens when nobody listens."""
    if not active:
        return False
    rows = df if topic is None else df.withColumn("topic", F.lit(topic))
    rows.write.mode("append").partitionBy("camera", "topic").parquet(path)
    return True


def write_routes(df: DataFrame, path: str) -> None:
    """One folder per output of `route_by_class`."""
    df.write.mode("overwrite").partitionBy("pub").parquet(path)


def write_detections(df: DataFrame, path: str, label: str = "label") -> None:
    """One folder per class; a line is image, score and box, separated by blanks."""
    lines = df.select(label, "frame", "score", "xmin", "ymin", "xmax", "ymax")
    lines.write.mode("overwrite").partitionBy(label).csv(path, sep=" ")


def read_detections(spark, path: str) -> DataFrame:
    """What `write_detections` wrote; the class comes back from the folder name."""
    schema = "frame long, score double, xmin double, ymin double, xmax double, ymax double, label long"
    return spark.read.schema(schema).csv(path, sep=" ")


def export_trace(df: DataFrame, path: str) -> None:
    """Timing trace with derived durations, one JSON object per query.

    Rows need start and end (ms) of ``enq``, ``in``, ``compute`` and ``out``.
    """
    spans = {n: F.col(f"{n}_end") - F.col(f"{n}_start") for n in ("enq", "in", "compute", "out")}
    out = df.withColumns({f"{n}_ms": c for n, c in spans.items()})
    out = out.withColumn("latency_ms", F.col("in_ms") + F.col("compute_ms") + F.col("out_ms"))
    out = out.withColumn("e2e_ms", F.col("out_end") - F.col("in_start"))
    out.write.mode("overwrite").json(path)
