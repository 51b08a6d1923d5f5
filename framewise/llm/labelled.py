"""Labelled texts, all of them or bounded samples, for the classifiers of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a NULL key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(0))


def one_label_per_key(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, ``_label`` 0 or 1): where a key has several labels, the larger one."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy(key).agg(F.max(label).cast("int").alias("_label"))


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, held: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, text, ``_label``) of all labelled rows that are not held out; ``held`` reads the key only.

    The labels are hashed by key, so texts are dealt without being sorted at any size.
    """
    known = one_label_per_key(labels, key, label).filter(~held)
    return docs.select(key, text).filter(~held).join(known.hint("shuffle_hash"), key)


def smallest(df: DataFrame, by: Column, n: int, total: int) -> DataFrame:
    """About the ``n`` rows of ``total`` with the smallest hash ``by``, never more.

    A first cut by the hash lets some four times ``n`` rows through, so that what is sorted,
    and what each task hands on, stays as small as the sample however large the table is.
    """
    steps = 1 << 30
    cut = min(steps, steps * 4 * n // max(1, total) + 1)
    return df.filter(F.pmod(by, F.lit(steps)) < cut).orderBy(F.pmod(by, F.lit(steps)), by).limit(n)


def sampled(
    docs: DataFrame, labels: DataFrame, label: str, held: Column, most: dict[int, int],
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, text, ``_label``) of labelled rows that are not held out.

    At most ``most[c]`` labels of class c are taken, those with the smallest hash of their key,
    so the sample has a known bound and no order of its own; it is broadcast to the documents.
    """
    known = one_label_per_key(labels, key, label).filter(~held)
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    parts = [
        smallest(known.filter(F.col("_label") == c), F.xxhash64(key), n, totals.get(c, 0)) for c, n in most.items()
    ]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    return docs.select(key, text).join(F.broadcast(chosen), key)
