"""Comparison of tensor values between two runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("iteration", "output")


def within(rtol: Column, atol: Column) -> Callable[[Column, Column], Column]:
    """abs(a - b) <= atol + rtol * abs(b); NaN never passes."""
    def test(a: Column, b: Column) -> Column:
        close = (a == b) | (F.abs(a - b) <= atol + rtol * F.abs(b))
        return close & ~F.isnan(a) & ~F.isnan(b)

    return test


def compare_runs(
    a: DataFrame, b: DataFrame, rtol: float | dict[str, float] = 1e-5,
    atol: float | dict[str, float] = 1e-5,
    compare: Callable[[Column, Column], Column] | None = None,
    match: dict[str, str] | None = None,
) -> DataFrame:
    """Per (iteration, output): whether all elements agree, and how far they differ.

    Inputs are rows (iteration, output, idx, val). Tolerances may be given per
    output (``""`` is the default entry). ``match`` pairs output names of ``a`` with
    those of ``b``. ``compare`` replaces the element test. An element without partner
    is a shape mismatch; an output that only one run has is skipped.
    """
    if match:
        names = F.create_map(*(F.lit(x) for pair in match.items() for x in pair))
        a = a.withColumn("output", F.coalesce(F.try_element_at(names, F.col("output")), "output"))
    left = a.select(*KEYS, "idx", F.col("val").alias("_a"), F.lit(True).alias("_ha"))
    right = b.select(*KEYS, "idx", F.col("val").alias("_b"), F.lit(True).alias("_hb"))
    both = left.join(right, [*KEYS, "idx"], "full_outer")
    test = compare or within(_tolerance(rtol), _tolerance(atol))
    va, vb = F.col("_a"), F.col("_b")
    paired = F.col("_ha") & F.col("_hb")
    diff = F.abs(va - vb)
    beyond = F.greatest(diff - _tolerance(atol), F.lit(0.0))
    relative = F.when(vb != 0, F.try_divide(beyond, F.abs(vb)))
    out = both.groupBy(*KEYS).agg(
        F.bool_and(F.coalesce(paired & test(va, vb), F.lit(False))).alias("matched"),
        F.bool_or(F.coalesce(~paired, F.lit(True))).alias("shape_mismatch"),
        F.count(F.lit(1)).alias("n"),
        F.max(diff).alias("max_abs"),
        F.avg(diff).alias("mean_abs"),
        # what atol would need to be with this rtol; max_rel is what rtol would need to be
        F.max(F.greatest(diff - _tolerance(rtol) * F.abs(vb), F.lit(0.0))).alias("required_atol"),
        F.max(relative).alias("max_rel"),
        F.avg(relative).alias("mean_rel"),
        F.min(va).alias("a_min"), F.min_by("idx", F.struct(va, F.col("idx"))).alias("a_argmin"),
        F.max(va).alias("a_max"), F.max_by("idx", F.struct(va, -F.col("idx"))).alias("a_argmax"),
        F.min(vb).alias("b_min"), F.min_by("idx", F.struct(vb, F.col("idx"))).alias("b_argmin"),
        F.max(vb).alias("b_max"), F.max_by("idx", F.struct(vb, -F.col("idx"))).alias("b_argmax"),
        F.count("_ha").alias("_na"), F.count("_hb").alias("_nb"),
    )
    # an output only one run has is skipped
    return out.filter((F.col("_na") > 0) & (F.col("_nb") > 0)).drop("_na", "_nb")


def _tolerance(t: float | dict[str, float]) -> Column:
    if not isinstance(t, dict):
        return F.lit(float(t))
    named = {k: v for k, v in t.items() if k}
    default = F.lit(float(t.get("", 1e-5)))
    if not named:
        return default
    table = F.create_map(*(F.lit(x) for k, v in named.items() for x in (k, float(v))))
    return F.coalesce(F.try_element_at(table, F.col("output")), default)


def pass_rate(cmp: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Matched, mismatched and all iterations, and the matched share (1.0 if there are none)."""
    per = cmp.groupBy(*keys, "iteration").agg(F.bool_and("matched").alias("_ok"))
    good, total = F.count_if("_ok"), F.count(F.lit(1))
    return per.groupBy(*keys).agg(
        good.alias("matched"), (total - good).alias("mismatched"), total.alias("total"),
        F.coalesce(F.try_divide(good.cast("double"), total.cast("double")), F.lit(1.0)).alias("share"),
    )


def tensor_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Type, element count, mean, extremes and their positions (first on ties)."""
    kind = df.schema["val"].dataType.simpleString()
    at_min = F.min_by("idx", F.struct("val", "idx"))
    at_max = F.max_by("idx", F.struct(F.col("val"), -F.col("idx")))
    return df.groupBy(*keys).agg(
        F.lit(kind).alias("dtype"), F.count(F.lit(1)).alias("n"), F.avg("val").alias("mean"),
        F.min("val").alias("min"), at_min.alias("argmin"), F.max("val").alias("max"),
        at_max.alias("argmax"),
    )


def postprocess(
    df: DataFrame, fn: Callable[[DataFrame], DataFrame], outputs: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Apply a user function to chosen outputs, leave the others as they are."""
    chosen = F.lit(True) if outputs is None else F.col("output").isin(*outputs)
    if exclude:
        chosen = chosen & ~F.col("output").isin(*exclude)
    return df.filter(chosen).transform(fn).unionByName(df.filter(~chosen))


def score_frames(
    df: DataFrame, fn: Callable, schema: str, batch_size: int = 15
) -> DataFrame:
    """Apply a user's model to batches of rows.

    ``fn`` gets a pandas frame of at most ``batch_size`` rows; the model stays the user's.
    """
    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                yield fn(pdf.iloc[start : start + batch_size])

    return df.mapInPandas(run, schema)
