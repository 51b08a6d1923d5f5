"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a schedule of weights over time, straight lines
between knots. The integral of a schedule is the source's weight in the mix; its running
integral, scaled to the source's target, is the demand for its words up to any time. A source's
documents are lined up in a fixed shuffled order, again and again until the target is reached;
the place of a document in that line, put through the inverse of the demand, is its training
position. Sorting by position over ranges gives the training order.

Cases: a NULL text has size 0 and takes nothing; a NULL source is a source of its own, the last
one; equal rows stand next to each other in the line; an empty table gives no rows; further
columns are not carried. All sums that decide are sums of whole numbers, so reruns agree. A hot
source is cut into buckets of about ``BUCKET`` rows: sums run inside a bucket, and bucket totals
are summed before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.words import SPACE_RUN, count_words, trimmed
from framewise.session import cut_lineage

BUCKET = 2048
PLACE_BITS = 60

Knots = Sequence[tuple[float, float]]

# weights 3, 1, 2 in turn: a falling, an even and a rising source
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 4.5), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)),
)


def integral(knots: Knots) -> float:
    return sum((a[1] + b[1]) * (b[0] - a[0]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def sized(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One narrow row per document: key, source, size and its place in the shuffled order."""
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10)
    return df.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), count_words(F.col(text)).alias("size"),
        place.cast("long").alias("_place"),
    )


def numbered_sources(docs: DataFrame) -> DataFrame:
    """Sources with their document counts, sizes and rank by code point, NULL last, from 0."""
    groups = docs.groupBy("_source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")
    )
    order = F.col("_source").asc_nulls_last()
    # places inside ordered ranges, then the rows of all ranges before
    ranged = cut_lineage(
        groups.repartitionByRange(order).sortWithinPartitions(order).select(
            "*", F.monotonically_increasing_id().alias("_m")
        )
    )
    at = F.shiftright("_m", 33)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(at.alias("_range")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return ranged.withColumn("_range", at).join(ranges, "_range").select(
        "_source", "source_size", "_docs",
        (F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("_rank"),
    )


def with_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by weight, at most ``cap`` times the source's size.

    What a source cannot take goes to the others by weight. The level (words per unit of weight)
    only rises from round to round, so the rounds end; each costs one sum over the sources.
    """
    limit = F.col("source_size") * F.lit(cap)
    total = sources.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, full = 0.0, -1
    exact = "decimal(38,9)"
    while True:
        above = F.col("_weight") * level > limit
        row = sources.agg(
            F.count_if(above).alias("full"), F.sum(F.when(above, F.col("source_size"))).alias("taken"),
            F.sum(F.when(~above, F.col("_weight").cast(exact))).alias("open"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full = row["full"]
        level = (share * total - cap * (row["taken"] or 0)) / float(row["open"])
    return sources.withColumn("target", F.least(limit, F.col("_weight") * F.lit(level)))


def _choose(rank: Column, values: Sequence[Column]) -> Column:
    return F.element_at(F.array(*values), (rank % len(values) + 1).cast("int"))


def _time_of(part: Column, knots: Column) -> Column:
    """The time at which a schedule's running integral reaches ``part`` of the whole.

    ``knots`` is an array of (t, w, area before). The time within a line from w0 with slope a
    solves w0 x + a x^2 / 2 = area; the form used has no division by a.
    """
    whole = F.element_at(knots, -1)["area"]
    want = part * whole
    seen = F.size(F.filter(knots, lambda k: k["area"] <= want))
    i = F.least(F.greatest(seen, F.lit(1)), F.size(knots) - 1)
    a, b = F.element_at(knots, i), F.element_at(knots, i + 1)
    need = want - a["area"]
    slope = (b["w"] - a["w"]) / (b["t"] - a["t"])
    root = F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * need, F.lit(0.0)))
    return F.least(a["t"] + F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (a["w"] + root)), b["t"])


def _literal(knots: Knots) -> Column:
    rows, area = [], 0.0
    for i, (t, w) in enumerate(knots):
        if i:
            area += (w + knots[i - 1][1]) * (t - knots[i - 1][0]) / 2
        rows.append(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w"), F.lit(area).alias("area")))
    return F.array(*rows)


def _lined_up(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their source's row and ``_start``, the words before them in their line."""
    on = docs["_source"].eqNullSafe(sources["_source"])
    df = docs.join(sources, on).drop("_source")
    bits = F.ceil(F.log2(F.greatest(F.col("_docs") / BUCKET, F.lit(1.0)))).cast("int")
    df = cut_lineage(
        df.withColumn("_bits", bits).withColumn("_bucket", F.expr(f"shiftright(_place, {PLACE_BITS} - _bits)"))
    )
    totals = df.groupBy("_rank", "_bucket").agg(F.sum("size").alias("_total"))
    before = Window.partitionBy("_rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rank", "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = (
        Window.partitionBy("_rank", "_bucket").orderBy("_place", "_key", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumn("_inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return df.join(offsets, ["_rank", "_bucket"]).withColumn("_start", F.col("_offset") + F.col("_inner"))


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    schedules: Sequence[Knots] = SCHEDULES, share: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, first position, and ``uses``.

    ``uses`` lists (epoch, taken, position) for each time the document is used. Schedules go to
    sources in turn, in the order of their names. The last document of a line may be cut.
    """
    docs = cut_lineage(sized(df, key, text, source))
    ranked = numbered_sources(docs)
    rank = F.col("_rank")
    weighted = cut_lineage(
        ranked.withColumn("_weight", _choose(rank, [F.lit(float(integral(k))) for k in schedules]))
    )
    sources = cut_lineage(with_targets(weighted, share, cap))
    lined = _lined_up(docs, sources)
    want = F.floor("target").cast("long")
    knots = _choose(rank, [_literal(k) for k in schedules])
    lined = lined.withColumn("_want", want)
    uses = []
    for epoch in range(-int(-cap // 1)):
        start = F.col("_start") + F.col("source_size") * epoch
        taken = F.greatest(F.lit(0), F.least(F.col("_want") - start, F.col("size"))).cast("long")
        part = start / F.greatest(F.col("_want"), F.lit(1))
        uses.append(
            F.struct(F.lit(epoch).alias("epoch"), taken.alias("taken"), _time_of(part, knots).alias("position"))
        )
    out = lined.withColumn("uses", F.filter(F.array(*uses), lambda u: u["taken"] > 0))
    return out.select(
        F.col("_key").alias(key), "size", "source_size", "target",
        F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["taken"]).alias("taken"),
        F.get("uses", F.lit(0))["position"].alias("position"), "uses",
    )


def training_order(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per use of a document, sorted by position over ranges; ties by key and epoch."""
    return (
        mixed.select(key, F.explode("uses").alias("u"))
        .select(key, F.col("u.epoch").alias("epoch"), F.col("u.taken").alias("taken"), F.col("u.position").alias("position"))
        .orderBy("position", key, "epoch")
    )


def repeated(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how: object
) -> DataFrame:
    """The rows of ``df`` as the mix uses them, sorted by training position over ranges.

    A row appears once per use, with all its columns. A use that takes only some of a text's
    words, as the end of a source's line does, has the first of them, joined by blanks.
    """
    row = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    named = df.select(row.alias("_row"), F.col(text).alias("_text"), F.col(source).alias("_from"))
    mixed = mix(named, "_row", "_text", "_from", **how)
    # equal rows are told apart by a number on both sides
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("position"))
    uses = mixed.select(F.col("_row").alias("_mx_at"), nth.alias("_mx_n"), "size", "uses").filter(F.size("uses") > 0)
    uses = cut_lineage(uses.select("_mx_at", "_mx_n", F.col("size").alias("_mx_size"), F.col("uses").alias("_mx_uses")))
    own = F.row_number().over(Window.partitionBy("_mx_row").orderBy("_mx_row"))
    rows = df.withColumn("_mx_row", row).withColumn("_mx_own", own)
    joined = rows.join(uses, (F.col("_mx_row") == F.col("_mx_at")) & (F.col("_mx_own") == F.col("_mx_n")))
    each = joined.withColumn("_mx_use", F.explode("_mx_uses"))
    words = F.split(trimmed(F.col(text)), SPACE_RUN)
    part = F.array_join(F.slice(words, F.lit(1), F.col("_mx_use.taken").cast("int")), " ")
    cut = F.when(F.col("_mx_use.taken") < F.col("_mx_size"), part).otherwise(F.col(text))
    ordered = each.withColumn(text, cut).withColumn("_mx_at", F.col("_mx_use.position"))
    ordered = ordered.repartitionByRange("_mx_at", "_mx_row").sortWithinPartitions("_mx_at", "_mx_row", "_mx_own")
    return ordered.select(*(f"`{c}`" for c in df.columns))
