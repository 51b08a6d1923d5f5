"""Line deduplication with a log-template tree of fixed depth.

A line is parsed down a tree: number of tokens, then its leading tokens, where a token with a
digit is the variable field ``<*>``; a longer line also goes down the branch that takes all
leading tokens as variable fields and splits by the next ones. In the leaf, the commonest token
of each place makes the leaf's template; lines that agree with it in at least ``similar`` of their
places follow it, the places where they do not are variable fields too. Every line is a template
of its own as well. A template that recurs in at least ``min_docs`` documents is dropped from all
of them but the first holder, so that boilerplate, shared passages and copied documents lose their
repeats while every passage stays in the corpus once.

Nothing gathers a leaf's lines in one place: places are counted as rows (leaf, place, token), and
a template array is as long as one line. Lines of fewer than ``SHORT`` tokens have no variable
fields and are only compared as a whole: where no blanks divide words, one token is a passage.
Cases: lines with fewer than ``min_tokens`` tokens, and lines without one, are kept and never
parsed; a NULL text stays NULL; equal rows are one document; the first holder is
the one with the smallest key (NULL last), ties go by a hash of the text; an empty table gives no
rows; other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.words import SPACE_CHARS, SPACE_RUN
from framewise.session import cut_lineage

DEPTH = 4
FIELD = "<*>"
SHORT = 3  # tokens
# a token with a digit, from its first character on and without looking back into it
WITH_DIGIT = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9]*+[0-9][^\\x20\\x09-\\x0D]*+"
BROADCAST_ROWS = 1_000_000  # of at most three numbers


def _trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)))


def _tokens(lines: DataFrame) -> DataFrame:
    """``lines`` (a column ``_line``, trimmed) with ``tokens``, variable fields masked."""
    given = [c for c in lines.columns if c != "_line"]
    rows = lines.select(
        *given, F.split("_line", SPACE_RUN).alias("_raw"),
        # cut again only where a digit was seen
        F.when(F.rlike("_line", F.lit("[0-9]")), F.regexp_replace("_line", WITH_DIGIT, FIELD)).alias("_masked"),
    )
    variable = F.col("_masked").isNotNull() & (F.size("_raw") >= SHORT)
    return rows.select(*given, F.when(variable, F.split("_masked", SPACE_RUN)).otherwise(F.col("_raw")).alias("tokens"))


def _lines(df: DataFrame, key: str, text: str, min_tokens: int, depth: int) -> DataFrame:
    """Rows (key, row, place, line, leaf, leaf2) of the lines to parse.

    ``leaf2`` is the leaf below the next tokens, which a line falls into as if its leading ones
    were variable fields; short lines have none, and those below ``SHORT`` tokens no leaf at all.
    """
    rows = df.select(
        F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_row"),
        F.posexplode(_trimmed_lines(F.col(text))).alias("_at", "_line"),
    )
    # a filter on the tokens would cut every line again
    rows = _tokens(rows.filter("_line <> ''"))
    rows = rows.filter(F.size("tokens") >= min_tokens) if min_tokens > 1 else rows
    n = F.size("tokens")
    second = F.when(n > 2 * depth, F.xxhash64(F.lit(FIELD), n, F.slice("tokens", depth + 1, depth)))
    return rows.select(
        "_key", "_row", "_at", F.xxhash64("tokens").alias("line"),
        F.when(n >= SHORT, F.xxhash64(n, F.slice("tokens", 1, depth))).alias("leaf"), second.alias("leaf2"),
    )


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a written table, broadcast if its row count is small enough."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def leaf_templates(df: DataFrame, slim: DataFrame, text: str, similar: float) -> DataFrame:
    """(line, templates) for the lines that follow the template of a leaf, at most two.

    Only lines that share a leaf with another line are looked at again: one holder of each is
    picked, and only the picked lines are cut into tokens and counted.
    """
    # plain numbers, which are added up without sorting; a line stands alike in all places of one text
    found = slim.filter(F.col("leaf").isNotNull()).groupBy("line").agg(
        F.first("leaf").alias("leaf"), F.first("leaf2").alias("leaf2"), F.count(F.lit(1)).alias("docs"),
        F.min("_row").alias("_row"), F.min_by("_at", "_row").alias("_at"),
    )
    found = cut_lineage(
        found.select("line", "docs", F.struct("_row", "_at").alias("_from"), F.explode(F.array_compact(F.array("leaf", "leaf2"))).alias("leaf"))
    )
    busy = cut_lineage(found.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("leaf"))
    members = cut_lineage(_joined(found, busy, ["leaf"]))
    picked = cut_lineage(members.select("_from._row", "_from._at", "line").distinct())
    holders = cut_lineage(picked.select("_row").distinct())
    texts = df.select(F.xxhash64(F.col(text)).alias("_row"), _trimmed_lines(F.col(text)).alias("_lines"))
    lines = _joined(texts, holders, ["_row"], "left_semi").select("_row", F.posexplode("_lines").alias("_at", "_line"))
    lines = _tokens(_joined(lines, picked, ["_row", "_at"]).select("line", "_line"))
    # texts that occur several times give their lines as often
    lines = cut_lineage(lines.groupBy("line").agg(F.first("tokens").alias("tokens")))
    placed = members.select("line", "leaf", "docs").join(lines, "line")
    counts = placed.select("leaf", "docs", F.posexplode("tokens").alias("at", "token"))
    counts = counts.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n"))
    common = counts.groupBy("leaf", "at").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    shapes = common.groupBy("leaf").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("shape")
    )
    same = F.size(F.filter(F.zip_with("tokens", "shape", lambda a, b: a == b), lambda x: x))
    follows = placed.join(shapes, "leaf").filter(same >= F.size("tokens") * F.lit(similar))
    return cut_lineage(follows.groupBy("line").agg(F.collect_set("leaf").alias("templates")))


def recurring_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 2, min_tokens: int = 3,
    depth: int = DEPTH, similar: float = 0.8,
) -> DataFrame:
    """(``_key``, ``_row``, ``_drop``): per document the places (from 0) of the lines to drop."""
    # keys are counted first: where each names one row, rows need no shuffle to be told apart
    counted = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    unique = counted.filter(F.col("k").isNull() | (F.col("n") > 1)).isEmpty()
    slim = _lines(df, key, text, min_tokens, depth)
    slim = cut_lineage(slim if unique else slim.distinct())
    follows = leaf_templates(df, slim, text, similar)
    # lines without a leaf are their own template only, and need no look at the leaves
    short = slim.filter(F.col("leaf").isNull()).select("_key", "_row", "_at", F.col("line").alias("template"))
    long = slim.filter(F.col("leaf").isNotNull()).join(follows, "line", "left").select(
        "_key", "_row", "_at",
        F.explode(F.when(F.col("templates").isNull(), F.array("line")).otherwise(F.concat(F.array("line"), "templates"))).alias("template"),
    )
    parsed = short.unionByName(long)
    # a written table, so that AQE can split the lines of a very common template in the join
    stats = cut_lineage(_recurring(parsed, min_docs, unique))
    holder = F.col("_key").eqNullSafe(F.col("_first")) & (F.col("_row") == F.col("_first_row"))
    return (
        parsed.join(stats, "template").filter(~holder)
        .groupBy("_key", "_row").agg(F.collect_set("_at").alias("_drop"))
    )


def _recurring(parsed: DataFrame, min_docs: int, unique: bool) -> DataFrame:
    """(template, ``_first``, ``_first_row``): templates of ``min_docs`` documents and their first holder.

    Where every row has a key of its own, a template with a smallest and another largest key is in
    two documents; they need not be listed.
    """
    if min_docs == 2 and unique:
        ends = parsed.groupBy("template").agg(
            F.min("_key").alias("_first"), F.max("_key").alias("last"), F.min_by("_row", "_key").alias("_first_row")
        )
        return ends.filter(F.col("_first") != F.col("last")).drop("last")
    order = F.struct(F.col("_key").isNull().alias("none"), "_key", "_row")
    docs = parsed.groupBy("template", "_key", "_row").agg(F.count(F.lit(1)).alias("n"))
    found = docs.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min(order).alias("f"))
    found = found.filter(F.col("docs") >= min_docs)
    return found.select("template", F.col("f._key").alias("_first"), F.col("f._row").alias("_first_row"))


def without_recurring_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_left: float = 0.0, drop_emptied: bool = False,
    **how: float,
) -> DataFrame:
    """``df`` with the repeats of recurring lines taken out of ``text``.

    With ``min_left``, documents that lost lines and have at most that share of their characters
    left go, with the lines they are the first holder of. With ``drop_emptied``, only documents go
    that lost lines and have no words left: they hold nothing, so every template keeps its holder.
    """
    cut = _cut(df.withColumn("_lt_size", F.length(F.col(text))), key, text, how)
    if min_left or drop_emptied:
        left = F.length(F.btrim(F.col(text), F.lit(SPACE_CHARS)))
        cut = cut.filter((F.col("_lt_dropped") == 0) | (left > F.col("_lt_size") * F.lit(min_left)))
    return cut.select(*(f"`{c}`" for c in df.columns))


def _cut(df: DataFrame, key: str, text: str, how: dict) -> DataFrame:
    """``df`` with ``text`` cut, and ``_lt_dropped`` and ``_lt_lines`` added."""
    drops = recurring_lines(df, key, text, **how).withColumnsRenamed(
        {"_key": "_lt_key", "_row": "_lt_hash", "_drop": "_lt_drop"}
    )
    on = F.col(key).eqNullSafe(F.col("_lt_key")) & (F.xxhash64(F.col(text)) == F.col("_lt_hash"))
    joined = df.join(drops, on, "left")
    lines = F.split(F.col(text), "\n")
    kept: Column = F.array_join(
        F.filter(lines, lambda _, i: ~F.array_contains("_lt_drop", i)), "\n"
    )
    return joined.withColumns(
        {
            "_lt_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "_lt_dropped": F.coalesce(F.size("_lt_drop"), F.lit(0)).cast("long"),
            text: F.when(F.col("_lt_drop").isNull(), F.col(text)).otherwise(kept),
        }
    )


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """Per document: key, ``text`` as kept, ``n_lines`` before, ``n_dropped``."""
    return _cut(df.select(key, text), key, text, how).select(
        key, text, F.col("_lt_lines").alias("n_lines"), F.col("_lt_dropped").alias("n_dropped")
    )
