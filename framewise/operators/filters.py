"""Row filters. All are plain predicates, so they reach the scan where the columns do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from framewise.operators.timeline import keep_spaced


def score_filter(df: DataFrame, threshold: float, strict: bool = False, score: str = "score"):
    c = F.col(score)
    return df.filter(c > threshold if strict else c >= threshold)


def depth_valid(df: DataFrame, low: int = 300, high: int = 12000, depth: str = "d") -> DataFrame:
    return df.filter((F.col(depth) > low) & (F.col(depth) < high))


def in_cube(df: DataFrame, side: float) -> DataFrame:
    """Half-open cube around the origin."""
    half = side / 2.0
    keep = F.lit(True)
    for axis in ("x", "y", "z"):
        keep = keep & (F.col(axis) >= -half) & (F.col(axis) < half)
    return df.filter(keep)


def in_image(df: DataFrame, W: int, H: int, u: str = "u", v: str = "v") -> DataFrame:
    return df.filter(F.col(u).between(0, W - 1) & F.col(v).between(0, H - 1))


def drop_label(df: DataFrame, background: int, label: str = "label") -> DataFrame:
    return df.filter(F.col(label) != background)


def valid_person(df: DataFrame, threshold: float) -> DataFrame:
    """Persons to keep; ``publishable`` tells which have a visible joint."""
    kept = df.filter(
        (F.col("n_valid") > 0) & ((F.col("conf") > threshold) | (F.col("n_occluded") > 0))
    )
    return kept.withColumn("publishable", F.col("n_valid") - F.col("n_occluded") > 0)


def validate(
    df: DataFrame, keys: list[str], value: str = "val", check_nan: bool = True,
    check_finite: bool = True,
) -> DataFrame:
    """Per output: counts of NaN and infinite values, and whether it passes."""
    v = F.col(value)
    infinite = F.abs(v) == float("inf")
    out = df.groupBy(*keys).agg(
        F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(infinite).alias("n_inf")
    )
    ok = F.lit(True)
    if check_nan:
        ok = ok & (F.col("n_nan") == 0)
    if check_finite:
        ok = ok & (F.col("n_inf") == 0)
    return out.withColumn("ok", ok)


def coerce_schema(
    df: DataFrame, schema: StructType, lengths: dict[str, int] | None = None
) -> DataFrame:
    """Columns matched by name, the rest by position, cast to ``schema``.

    ``lengths`` fixes the size of array columns; a row of another size fails the job.
    """
    if len(df.columns) < len(schema.fields):
        raise ValueError(f"need {len(schema.fields)} columns, got {len(df.columns)}")
    named = {f.name for f in schema.fields} & set(df.columns)
    spare = iter(c for c in df.columns if c not in named)
    out: list[Column] = []
    for field in schema.fields:
        source = F.col(field.name if field.name in named else next(spare))
        cast = source.cast(field.dataType)
        want = (lengths or {}).get(field.name)
        if want is not None:
            if not isinstance(field.dataType, ArrayType):
                raise ValueError(f"{field.name} is not an array")
            fits = F.size(source) == want
            cast = F.when(fits, cast).otherwise(
                F.raise_error(F.lit(f"{field.name}: length differs from {want}"))
            )
        out.append(cast.alias(field.name))
    return df.select(*out)


def throttle(
    df: DataFrame, key: str, spacing: float, ts: str = "ts", tie: str | None = None,
    chunk: float = 3600.0,
) -> DataFrame:
    """At most one row per key within ``spacing`` seconds of the last kept row."""
    return keep_spaced(df, key, ts, spacing, tie, chunk)
