"""Aggregations on clouds, depth, traces and run times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators.scale import join_on, order_columns, ranked, row_at, rows_at, with_buckets

_MEAN = ("x", "y", "z")


def voxel_filter(
    pts: DataFrame, side: float = 20.0, voxel: float = 0.05, keys: Sequence[str] = ("frame",)
) -> DataFrame:
    """Mean point and count per cubic cell of a cube around the origin."""
    n = int(side / voxel)
    scale = n / side
    half = side / 2.0
    inside = F.lit(True)
    for a in _MEAN:
        inside = inside & (F.col(a) >= -half) & (F.col(a) < half)
    cell = [(F.floor(F.col(a) * scale) + n // 2).alias(f"v{a}") for a in _MEAN]
    return (
        pts.filter(inside)
        .groupBy(*keys, *cell)
        .agg(*(F.avg(a).alias(a) for a in _MEAN), F.count(F.lit(1)).alias("n_points"))
    )


def index_quantile(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: str = "third"
) -> DataFrame:
    """The row at a sorted index of its group.

    ``rule``: ``third`` n/3, ``far`` min(0.8 n, n - 1), ``quarter`` n/4, ``half`` n/2
    (all integer parts). ``order`` ends in a unique column.
    """
    return row_at(df, keys, order, lambda n: quantile_index(n, rule))


def index_quantiles(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rules: Sequence[str]
) -> DataFrame:
    """`index_quantile` for several rules at once: one selection, the rule named in ``rule``."""
    return rows_at(df, keys, order, {x: lambda n, x=x: quantile_index(n, x) for x in rules})


def quantile_index(n: Column, rule: str) -> Column:
    rules = {
        "third": F.floor(n / 3),
        "far": F.least(F.floor(n * 0.8), n - 1),
        "quarter": F.floor(n / 4),
        "half": F.floor(n / 2),
    }
    return rules[rule].cast("long")


def runtime_means(
    df: DataFrame, value: str, by: str = "n_det", low: int = 1, high: int = 9
) -> DataFrame:
    """Mean run time overall (NULL ``by``) and by number of detections low..high."""
    return (
        df.rollup(by)
        .agg(F.avg(value).alias("mean_ms"), F.count(F.lit(1)).alias("n"), F.grouping(by).alias("_g"))
        .filter((F.col("_g") == 1) | F.col(by).between(low, high))
        .drop("_g")
    )


def percentile_floor(
    df: DataFrame, p: float, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The row at sorted index int(n * p)."""
    return row_at(df, keys, order, lambda n: F.least(F.floor(n * p), n - 1))


def latency_report(
    trace: DataFrame, keys: Sequence[str], warmup_ms: float, percentile: float, tie: str,
    queries: int = 1, start: str = "start_ms",
) -> DataFrame:
    """Statistics of ``latency``, ``e2e`` and ``compute`` per group, warm-up dropped.

    Rows: keys, metric, min, max, mean, median, percentile, count, throughput (per s).
    Sums come from one aggregation over the trace; the sorted positions of each metric are
    selected, so only the buckets that hold them are ranked.
    """
    kept = trace.filter(F.col(start) >= warmup_ms)
    metrics = ("latency", "e2e", "compute")
    wall = F.max(F.col(start) + F.col("latency")) - F.min(start)
    sums = kept.groupBy(*keys).agg(
        wall.alias("_wall"), F.count(F.lit(1)).alias("count"),
        *(f(m).alias(f"_{n}_{m}") for m in metrics for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))),
    )
    each = F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"_{n}_{m}").alias(n) for n in ("min", "max", "mean"))) for m in metrics))
    stats = sums.select(*keys, "_wall", "count", F.explode(each).alias("_m")).select(*keys, "_wall", "count", "_m.*")
    wanted = {
        "low": lambda n: F.when(n % 2 == 1, F.floor(n / 2)).otherwise(F.floor(n / 2) - 1),
        "middle": lambda n: F.floor(n / 2),
        "cut": lambda n: F.greatest(n - 1 - F.floor(n * (1.0 - percentile / 100.0)), F.lit(0)),
    }
    found = None
    for m in metrics:
        own = rows_at(kept.select(*keys, tie, F.col(m).alias("v")), keys, ["v", tie], wanted)
        own = own.groupBy(*keys).agg(
            F.avg(F.when(F.col("rule") != "cut", F.col("v"))).alias("median"),
            F.max(F.when(F.col("rule") == "cut", F.col("v"))).alias("percentile"),
        ).withColumn("metric", F.lit(m))
        found = own if found is None else found.unionByName(own)
    rate = F.try_divide(F.col("count") * float(queries) * 1000.0, F.col("_wall"))
    out = join_on(stats, found, [*keys, "metric"])
    return out.select(*keys, "metric", "min", "max", "mean", "median", "percentile", "count", rate.alias("throughput"))


def block_means(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, values: Sequence[str]
) -> DataFrame:
    """Means over blocks of ``k`` consecutive rows; an incomplete last block is dropped."""
    rows = ranked(df, keys, order, "_rn").withColumn("block", F.floor((F.col("_rn") - 1) / k))
    out = rows.groupBy(*keys, "block").agg(
        *(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("_n")
    )
    return out.filter(F.col("_n") == k).drop("_n")


def standardize(df: DataFrame, keys: Sequence[str], col: str, eps: float = 1e-5) -> DataFrame:
    """(x - mean) / sqrt(population variance + eps) within a group.

    The moments are combined before the shuffle and joined back.
    """
    moments = df.groupBy(*keys).agg(F.avg(col).alias("_m"), F.var_pop(col).alias("_v"))
    out = join_on(df, moments, keys)
    z = (F.col(col) - F.col("_m")) / F.sqrt(F.col("_v") + eps)
    return out.withColumn("standardized", z).drop("_m", "_v")


def strided_sample(
    df: DataFrame, order: Sequence[str], k: int, batch_size: int
) -> DataFrame:
    """Every k-th row in ``order``, packed into full batches; n / k / size of them."""
    total = df.count()
    batches = total // k // batch_size
    rows = ranked(df, [], order, "_rn").filter((F.col("_rn") - 1) % k == 0)
    at = F.floor((F.col("_rn") - 1) / k)
    return (
        rows.withColumn("batch", F.floor(at / batch_size))
        .withColumn("slot", at % batch_size)
        .filter(F.col("batch") < batches)
        .drop("_rn")
    )


def limit_rows(
    df: DataFrame, order: Sequence[str], n: int, batch: int | None = None, small: int = 10_000
) -> DataFrame:
    """The first ``n`` rows in ``order``; with ``batch`` only whole batches.

    Up to ``small`` rows every task hands on its first ones. Beyond that the rows are counted per
    bucket of the order: buckets before the cut are taken whole, and only the one the cut falls
    into is ranked, so no task sees more than a bucket.
    """
    if n <= small:
        take = n
        if batch is not None:
            take = min(n, df.limit(n).count()) // batch * batch
        return df.orderBy(*order_columns(order)).limit(take)
    bucketed = with_buckets(df, order)
    # as many numbers as there are buckets
    sizes = sorted((r["_bucket"], r["n"]) for r in bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect())
    take = min(n, sum(m for _, m in sizes))
    take = take // batch * batch if batch is not None else take
    before, cut = 0, None
    for bucket, m in sizes:
        if before + m > take:
            cut = bucket
            break
        before += m
    if cut is None:
        return df.orderBy(*order_columns(order))
    first = Window.partitionBy("_bucket").orderBy(*order_columns(order))
    rest = bucketed.filter(F.col("_bucket") == cut).withColumn("_rn", F.row_number().over(first))
    rows = bucketed.filter(F.col("_bucket") < cut).unionByName(rest.filter(F.col("_rn") <= take - before).drop("_rn"))
    return rows.drop("_bucket").orderBy(*order_columns(order))


def topk(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, rank: str | None = None
) -> DataFrame:
    """Best ``k`` rows per key; Spark trims each partition to k rows before the shuffle."""
    from framewise.operators.scale import order_columns

    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order_columns(order))
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_topk(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, pad: bool = False
) -> DataFrame:
    """Best ``k`` over all classes with the number of valid ones; empty slots have label -1."""
    best = topk(df, keys, order, k, rank="slot")
    counts = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid"))
    if not pad:
        return join_on(best, counts, keys)
    slots = counts.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(k))))
    out = join_on(slots, best, [*keys, "slot"])
    fill = {
        f.name: 0
        for f in df.schema.fields
        if f.name not in (*keys, "label") and f.dataType.typeName() in ("double", "long", "integer")
    }
    return out.fillna(fill).fillna({"label": -1})


def tile(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


