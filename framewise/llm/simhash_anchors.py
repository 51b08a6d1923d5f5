"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, and two are linked if they differ in at most two. Low and high bits
share the work: of two linked fingerprints either the high 33 bits are equal, or the low 31
differ in at most one bit. For the low part the anchors are the words of the [31, 26] Hamming
code: every value has one within radius 1, so two values one bit apart both lie within 1 + 1 of
that anchor. Each fingerprint goes to all anchors within 2 (at most 16) and to its high part
(the trivial code of radius 0), and is compared with the others there.

Anchors with more than ``CROWD`` different fingerprints, as a large family of near copies makes
them, are not compared pair by pair. Their fingerprints are written once for themselves and each
of their 64 one-bit changes; two are linked exactly if they share such a variant, and no variant
has more than 65 owners. So every link is found at linear cost, whatever the crowd.

Only different fingerprints are compared: equal ones are one vertex from the start. Cases: texts
without words, NULL ones too, have fingerprint 0 and are linked like any other; a NULL key takes
part but never names a component; equal rows are members of one component; an empty table gives
no rows; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.operators.neighbours import components
from framewise.session import cut_lineage

SEED = 42
SHINGLE = 3
LOW_BITS = 31
THRESHOLD = 2
CROWD = 64
HIGH_FLAG = 1 << 40


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """One hash per shingle, a shorter text being one shingle; none for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        parts = []
    elif len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, SEED) for p in parts], dtype="<u8")


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_of(t) for t in batch], dtype="int64")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn(name, F.pandas_udf(fingerprints, "long")(F.col(text)))


def anchors_of(fp: Column) -> Column:
    """All anchors of a fingerprint: Hamming code words near its low bits, and its high bits."""
    low = fp.bitwiseAND((1 << LOW_BITS) - 1)
    # the syndrome names the place (from 1) of the bit that leads to the nearest code word
    syndrome = F.lit(0).cast("long")
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, LOW_BITS + 1) if p >> k & 1)
        odd = F.bit_count(low.bitwiseAND(mask)).cast("long").bitwiseAND(1)
        syndrome = syndrome.bitwiseOR(odd * (1 << k))
    place = [F.lit(1 << (p - 1)).cast("long") for p in range(1, LOW_BITS + 1)]
    bits = F.array(*place)
    far = F.transform(
        F.filter(
            F.sequence(F.lit(1).cast("long"), F.lit(LOW_BITS).cast("long")), lambda i: i < i.bitwiseXOR(syndrome)
        ),
        lambda i: low.bitwiseXOR(F.element_at(bits, i.cast("int")))
        .bitwiseXOR(F.element_at(bits, i.bitwiseXOR(syndrome).cast("int"))),
    )
    near = low.bitwiseXOR(F.element_at(bits, syndrome.cast("int")))
    high = F.shiftrightunsigned(fp, LOW_BITS).bitwiseOR(HIGH_FLAG)
    own = F.when(syndrome == 0, F.array(low)).otherwise(F.concat(F.array(near), far))
    return F.concat(own, F.array(high))


def links(classes: DataFrame, fp: str = "fp", crowd: int = CROWD) -> DataFrame:
    """Enough links (a < b) between different fingerprints to join each component."""
    near = classes.select(F.col(fp).alias("f"), F.explode(anchors_of(F.col(fp))).alias("anchor"))
    sizes = cut_lineage(near.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = cut_lineage(near.join(sizes, "anchor"))
    few = met.filter(F.col("n") <= crowd)
    a, b = few.select("anchor", F.col("f").alias("a")), few.select("anchor", F.col("f").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD
    pairs = a.join(b, "anchor").filter((F.col("a") < F.col("b")) & close).select("a", "b")
    crowded = met.filter(F.col("n") > crowd).select("f").distinct()
    ones = F.array(F.lit(0).cast("long"), *(F.expr(f"shiftleft(1L, {i})") for i in range(64)))
    owners = (
        crowded.select("f", F.explode(ones).alias("bit"))
        .groupBy(F.col("f").bitwiseXOR(F.col("bit")).alias("variant"))
        .agg(F.collect_set("f").alias("fs")).filter(F.size("fs") > 1)
    )
    star = owners.select(F.array_min("fs").alias("a"), F.explode("fs").alias("b")).filter("a < b")
    return cut_lineage(pairs.unionByName(star).distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest key that links lead to, the own one included.
    """
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    docs = cut_lineage(with_fingerprint(docs, "_text", "fp").select("_key", "fp"))
    named = component_names(docs)
    return docs.join(named, "fp").select(
        F.col("_key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def component_names(docs: DataFrame) -> DataFrame:
    """(fp, component_id) from rows of ``_key`` and ``fp``."""
    classes = cut_lineage(docs.groupBy("fp").agg(F.min("_key").alias("_least")))
    found = components(links(classes), []).select(F.col("vertex").alias("fp"), F.col("component").alias("_c"))
    members = classes.join(found, "fp", "left").withColumn("_c", F.coalesce("_c", "fp"))
    names = members.groupBy("_c").agg(F.min("_least").alias("component_id"))
    return cut_lineage(members.join(names, "_c").select("fp", "component_id"))
