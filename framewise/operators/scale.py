"""Ranking and running sums that survive a hot key.

A plain window sends all rows of a key to one task. The operators here cut
every key into ordered buckets first: rows are ranked (or summed) inside a
bucket, the small table of bucket totals is accumulated per key, and each row
adds the total of the buckets before its own. One key may then hold any share
of the table; a task never sees more than one bucket of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.session import cut_lineage


def order_columns(order: Sequence[str]) -> list[Column]:
    """``-name`` means descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that also pairs NULL keys, so no row is lost; keeps the left keys."""
    if not keys:
        # the right side is a single row here: totals over the whole table
        return left.join(F.broadcast(right))
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__{k}"])
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*(f"__{k}" for k in keys))


def _sort_value(df: DataFrame, spec: str) -> Column | None:
    name = spec.lstrip("-")
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        value = F.unix_micros(F.col(name).cast("timestamp"))
    elif kind in ("byte", "short", "integer", "long", "float", "double"):
        value = F.col(name)
    else:
        return None
    return -value if spec.startswith("-") else value


CASES = 1024  # bounds that are compared by code; more are looked up in an array


def _literal(value: float | int) -> str:
    if isinstance(value, int):
        return f"{value}L"
    return f"{value!r}D" if np.isfinite(value) else f"double('{value}')"


def _below(bounds: list[float | int], name: str, inclusive: bool) -> Column:
    """How many of the sorted ``bounds`` lie below column ``name``, by halving."""
    sign = "<=" if inclusive else "<"
    if len(bounds) > CASES:
        array = F.array(*map(F.lit, bounds))
        step = int(len(bounds) ** 0.5)

        def under(b: Column) -> Column:
            return b <= F.col(name) if inclusive else b < F.col(name)

        coarse = F.size(F.filter(array, lambda b, i: (i % step == 0) & under(b)))
        start = F.greatest((coarse - 1) * step, F.lit(0))
        return start + F.size(F.filter(F.slice(array, start + 1, step), under))

    def count(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        test = f"{_literal(bounds[middle])} {sign} {name}"
        return f"CASE WHEN {test} THEN {count(middle + 1, high)} ELSE {count(low, middle)} END"

    return F.expr(count(0, len(bounds)))


def with_buckets(
    df: DataFrame, order: Sequence[str], name: str = "_bucket", buckets: int | None = None
) -> DataFrame:
    """Add a bucket number that rises with ``order``, about equally filled.

    The bounds are approximate quantiles of the first order column if that is a
    number or a time; a value so frequent that it is a bound itself gets a bucket of
    its own, which the second order column splits further. Orders with other types
    are dealt into ranges over all order columns and written once, as ranges come
    from a sample. Buckets only balance the work, the result of an operator does not
    depend on where the bounds fall.
    """
    conf = df.sparkSession.conf
    n = buckets or max(64, int(conf.get("spark.sql.shuffle.partitions", "200")))
    first = _sort_value(df, order[0])
    second = _sort_value(df, order[1]) if len(order) > 1 else None
    if first is None or (len(order) > 1 and second is None):
        ranges = df.repartitionByRange(n, *order_columns(order))
        return cut_lineage(ranges.withColumn(name, F.spark_partition_id().cast("long")))
    cuts = [i / n for i in range(1, n)]
    values = [v for v in (first, second) if v is not None]
    # at most 2 n numbers; read once, not once for each use of the result
    found = df.agg(*(F.sort_array(F.array_distinct(F.percentile_approx(v, cuts))) for v in values)).first()
    bounds = [list(b or []) for b in found]
    out = df.withColumns({f"_v{i}": v for i, v in enumerate(values)})
    hot = F.col("_v0").isin(bounds[0]) if bounds[0] else F.lit(False)
    rank = _below(bounds[0], "_v0", False) * 2 + hot.cast("int")
    inner = F.lit(0)
    if second is not None:
        inner = F.when(hot, _below(bounds[1], "_v1", True)).otherwise(F.lit(0))
    number = rank.cast("long") * (n + 1) + inner
    # NULL sorts first when ascending and last when descending
    missing = (1 << 62) if order[0].startswith("-") else -1
    number = F.when(F.col("_v0").isNotNull(), number).otherwise(F.lit(missing).cast("long"))
    return out.withColumn(name, number).drop("_v0", "_v1")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, Column]],
    bucket: str | None = None,
    before: bool = False,
) -> DataFrame:
    """Running aggregates per key in ``order``, row included unless ``before``.

    ``aggs`` maps an output name to (``sum`` | ``count`` | ``min`` | ``max``,
    value). ``order`` must end in a column that is unique within the key.
    """
    fold = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    own = bucket is None
    if own:
        df, bucket = with_buckets(df, order), "_bucket"
    part = [*keys, bucket]
    end = -1 if before else Window.currentRow
    local = Window.partitionBy(*part).orderBy(*order_columns(order)).rowsBetween(
        Window.unboundedPreceding, end
    )
    rows = df.select("*", *(fold[k](v).over(local).alias(f"_l_{n}") for n, (k, v) in aggs.items()))
    totals = df.groupBy(*part).agg(*(fold[k](v).alias(f"_t_{n}") for n, (k, v) in aggs.items()))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    carry = totals.select(
        *part, *(merge[k](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in aggs.items())
    )
    out = join_on(rows, carry, part)

    def combine(n: str, kind: str) -> Column:
        a, b = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind == "min":
            return F.least(a, b)
        if kind == "max":
            return F.greatest(a, b)
        return F.coalesce(a + b, a, b)

    out = out.withColumns({n: combine(n, k) for n, (k, _) in aggs.items()})
    out = out.drop(*(p + n for n in aggs for p in ("_l_", "_c_")))
    return out.drop(bucket) if own else out


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
    bucket: str | None = None,
) -> DataFrame:
    """Row number per key in ``order``, from 1, without gathering a key in one task."""
    out = running(df, keys, order, {name: ("count", F.lit(1))}, bucket)
    return out.withColumn(name, F.col(name).cast("long"))


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Attach the size of the row's group; the count is combined before the shuffle."""
    return join_on(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)


def max_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; one aggregation over the key columns only."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


SMALL_GROUP = 256  # rows of a group that are compared with each other in place, without cells


def groups_are_small(keys: Sequence[str], *frames: DataFrame, most: int = SMALL_GROUP) -> bool:
    """Whether no group of any of the frames is over ``most`` rows, nor over ``SMALL_GROUP``."""
    return all(max_group(df, keys) <= min(most, SMALL_GROUP) for df in frames)


def split_by_size(df: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups up to ``limit``, and rows of larger groups."""
    sized = with_group_size(df, keys, "_size")
    return (
        sized.filter(F.col("_size") <= limit).drop("_size"),
        sized.filter(F.col("_size") > limit).drop("_size"),
    )


def rows_at(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: dict[str, Callable[[Column], Column]],
    name: str = "rule",
) -> DataFrame:
    """The rows at wanted sorted positions of their group, with the group size ``n`` and the position's name.

    ``wanted`` maps a name to a zero-based position, given as a function of the group size. Rows
    are only counted per bucket; the totals tell which bucket holds a position, and nothing but
    these buckets is ranked. A position outside the group has no row.
    """
    bucketed = with_buckets(df, order)
    part = [*keys, "_bucket"]
    totals = bucketed.groupBy(*part).agg(F.count(F.lit(1)).alias("_m"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.select(
        *part, "_m", F.sum("_m").over(group).alias("n"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_from")
    )
    at = F.array(
        *(F.struct(F.lit(k).alias("rule"), (f(F.col("n")).cast("long") + 1 - F.col("_from")).alias("pos")) for k, f in wanted.items())
    )
    hits = placed.withColumn("_at", F.filter(at, lambda x: x["pos"].between(1, F.col("_m"))))
    # written, so that its size decides whether the rows need a shuffle to find their buckets
    hits = cut_lineage(hits.filter(F.size("_at") > 0).select(*part, "n", "_at"))
    local = Window.partitionBy(*part).orderBy(*order_columns(order))
    rows = join_on(bucketed, hits, part, "inner").withColumn("_rn", F.row_number().over(local).cast("long"))
    found = F.filter("_at", lambda x: x["pos"] == F.col("_rn"))
    out = rows.withColumn("_hit", F.explode(found)).withColumn(name, F.col("_hit.rule"))
    return out.drop("_hit", "_at", "_rn", "_bucket")


def row_at(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], index: Callable[[Column], Column]
) -> DataFrame:
    """The row at a zero-based sorted position, given as a function of the group size."""
    return rows_at(df, keys, order, {"": index}, "_rule").drop("_rule")


def map_groups(
    df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema
) -> DataFrame:
    """``fn`` on each of very many small groups, several groups to an Arrow batch.

    Rows are hashed on ``keys`` and sorted, so a group is a run of rows; a run cut by
    the end of a batch is carried into the next. The caller bounds the group size.
    Groups are told apart by the text of their keys, in which NULL is a value and long
    numbers keep all digits.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            starts = _run_starts(pdf["_group"])
            if len(starts) == 0:
                continue
            held = pdf.iloc[starts[-1] :]
            out = [fn(pdf.iloc[a:b][columns]) for a, b in zip(starts[:-1], starts[1:])]
            out = [o for o in out if len(o)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held is not None and len(held):
            yield fn(held[columns])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    named = df.withColumn("_group", F.to_json(F.struct(*keys)))
    placed = named.repartition(n, "_group").sortWithinPartitions("_group")
    return placed.mapInPandas(run, schema)


def _run_starts(group: pd.Series) -> np.ndarray:
    if not len(group):
        return np.array([], dtype=int)
    v = group.to_numpy()
    return np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
