"""Readers: logs, label lists, path-text pairs, annotations, question files, generated inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = (
    "filename string, size struct<width:int,height:int,depth:int>, "
    "object array<struct<name:string,pose:string,truncated:int,difficult:int,"
    "bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
)
QUESTIONS = (
    "data array<struct<title:string,paragraphs:array<struct<context:string,"
    "qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
)


def read_log(spark: SparkSession, path: str, topic: str, t0: str | None = None, ts: str = "ts"):
    """Messages of one topic from ``t0`` on; without it from the first message of the log.

    ``topic`` is a partition column, so other topics are not read.
    """
    log = spark.read.parquet(path)
    rows = log.filter(F.col("topic") == topic)
    if t0 is not None:
        return rows.filter(F.col(ts) >= F.lit(t0).cast(log.schema[ts].dataType))
    return rows


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``<number><text>`` to id and name; other lines are left out."""
    form = r"^\s*(\d+)(.+)$"
    lines = spark.read.text(path).filter(F.col("value").rlike(form))
    return lines.select(
        F.regexp_extract("value", form, 1).cast("int").alias("id"),
        F.trim(F.regexp_extract("value", form, 2)).alias("name"),
    )


def read_pairs(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Lines of path and text; a line with another number of fields fails the job."""
    parts = F.split(F.trim("value"), "\\" + sep if len(sep) == 1 else sep)
    bad = F.raise_error(F.concat(F.lit("not two fields: "), F.col("value")))
    checked = spark.read.text(path).select(F.when(F.size(parts) == 2, parts).otherwise(bad).alias("p"))
    return checked.select(F.get("p", F.lit(0)).alias("path"), F.get("p", F.lit(1)).alias("text"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Objects of XML annotations: name, difficult, truncated, zero-based box, image size."""
    xml = spark.read.format("xml").option("rowTag", "annotation").schema(ANNOTATION).load(path)
    rows = xml.select("filename", "size", F.explode("object").alias("o"))
    return rows.select(
        "filename", F.col("o.name").alias("name"), (F.col("o.difficult") == 1).alias("difficult"),
        (F.col("o.truncated") == 1).alias("truncated"),
        *((F.col(f"o.bndbox.{c}") - 1).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")),
        F.col("size.width").alias("width"), F.col("size.height").alias("height"),
    )


def read_qa_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per question of data / paragraphs / qas files, with the accepted answers."""
    raw = spark.read.schema(QUESTIONS).json(path, multiLine=multi_line)
    rows = raw.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    rows = rows.select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return rows.select(
        F.col("q.id").alias("id"), "context", F.col("q.question").alias("question"),
        F.transform("q.answers", lambda a: a["text"]).alias("answers"),
    )


def generate_inputs(
    spark: SparkSession, schema: dict[str, tuple[str, int]], iterations: int, seed: int = 1,
    int_range: tuple[int, int] = (1, 25), float_range: tuple[float, float] = (-1.0, 1.0),
) -> DataFrame:
    """Reproducible tensors: rows (iteration, output, idx, val).

    ``schema`` maps a name to (``int`` | ``bool`` | ``float``, number of elements). Each
    value is a hash of seed + iteration, name and index, so it does not depend on how
    the rows are partitioned.
    """
    parts = []
    for name, (kind, size) in schema.items():
        at = F.col("id")
        rows = spark.range(iterations * size).select(
            F.floor(at / size).alias("iteration"), F.lit(name).alias("output"), (at % size).alias("idx")
        )
        bits = F.xxhash64(F.col("iteration") + seed, "output", "idx")
        # 53 bits make a double in 0..1
        u = F.shiftrightunsigned(bits, 11) / float(1 << 53)
        if kind == "int":
            value = F.floor(u * (int_range[1] - int_range[0] + 1)) + int_range[0]
        elif kind == "bool":
            value = F.floor(u * 2)
        elif kind == "float":
            value = u * (float_range[1] - float_range[0]) + float_range[0]
        else:
            raise ValueError(f"unknown kind {kind!r}")
        parts.append(rows.withColumn("val", value.cast("double")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
