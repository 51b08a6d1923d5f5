"""Quality classifier: a linear support vector machine on naive Bayes scaled n-gram indicators.

Features are which n-grams occur in a text: one to three bytes, hashed into a fixed number of
slots, and one to three words seen as kinds of words (same as the word before, upper case, with
symbols, plain). Each indicator is scaled by the log ratio of its smoothed counts in the two
classes, and a hinge-loss model is fitted on the scaled vectors by dual coordinate descent.

Labels come only from rows that are not held out, at most ``SAMPLE`` keys per class; the model is
a vector of fixed length. Scoring is one pass over the whole texts. Cases: a NULL or empty text
has no features and gets the score of the bias; equal texts get equal scores; a NULL key is never
a label's; without labels of both classes every score is 0.5; an empty table gives no rows;
further columns are not carried by ``scored`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.labelled import fold, sampled

SAMPLE = 1500  # keys per class
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
KINDS = 4  # plain, upper, symbols, same
KIND_GRAMS = KINDS + KINDS**2 + KINDS**3
CHUNK = 1 << 20  # bytes looked at together
ACCEPT = 0.5


def _byte_slots(data: np.ndarray) -> Iterator[np.ndarray]:
    """Slots of the 1- to 3-grams of some bytes (as uint32)."""
    pair = data[:-1] | data[1:] << 8
    three = pair[:-1] | data[2:] << 16
    for grams, salt in ((data, 1), (pair, 2), (three, 3)):
        yield (grams * np.uint32(4) + np.uint32(salt)) * np.uint32(2654435761) >> np.uint32(32 - SLOT_BITS)


def _kind_slots(words: list[bytes]) -> np.ndarray:
    same = np.fromiter(map(eq, words[1:], words[:-1]), bool, len(words) - 1)
    upper = np.fromiter(map(bytes.isupper, words), bool, len(words))
    plain = np.fromiter(map(bytes.isalpha, (w.strip(b".,") for w in words)), bool, len(words))
    beyond = np.fromiter((not w.isascii() for w in words), bool, len(words))
    kind = np.where(plain | beyond, 0, 2)
    kind[upper] = 1
    kind[1:][same] = 3
    pair = kind[:-1] * KINDS + kind[1:]
    three = pair[:-1] * KINDS + kind[2:]
    return np.unique(np.concatenate([kind, KINDS + pair, KINDS + KINDS**2 + three]))


def features(text: str | None, flags: np.ndarray | None = None) -> np.ndarray:
    """Sorted slots of the n-grams that occur. ``flags``: an all-false scratch array to reuse."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.empty(0, np.int64)
    flags = np.zeros(SLOTS, bool) if flags is None else flags
    raw = np.frombuffer(data, np.uint8)
    for i in range(0, len(raw), CHUNK):
        for slots in _byte_slots(raw[i : i + CHUNK + 2].astype(np.uint32)):
            flags[slots] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return np.concatenate([found, SLOTS + _kind_slots(words)])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum() / np.sqrt(max(1, len(slots))) + self.bias)

    def score(self, slots: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-4.0 * np.clip(self.margin(slots), -50.0, 50.0))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, width: int, smooth: float = 1.0) -> np.ndarray:
    """log of each n-gram's smoothed share in class 1 over its share in class 0."""
    counts = np.full((2, width), smooth)
    for slots, label in zip(rows, labels, strict=True):
        counts[int(label), slots] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, rounds: int = 30) -> Model:
    """Hinge loss with an L2 penalty in the dual, one coordinate (one text) at a time."""
    width = SLOTS + KIND_GRAMS
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(width), 0.0)
    ratio = log_ratios(rows, labels, width)
    values = [ratio[s] / np.sqrt(max(1, len(s))) for s in rows]
    sign = np.where(labels == 1, 1.0, -1.0)
    diagonal = np.array([v @ v + 1.0 for v in values])  # 1 for the bias
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), c)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return Model(w * ratio, bias)


def train(
    docs: DataFrame, labels: DataFrame, held: Column, key: str = "doc_id", text: str = "text",
    label: str = "quality", sample: int = SAMPLE,
) -> Model:
    """Fit on the bounded sample; what comes to the driver are slots, at most SLOTS per text."""
    chosen = sampled(docs, labels, label, held, {0: sample, 1: sample}, key, text)
    found = chosen.select(F.col("_label"), F.pandas_udf(_slots, "array<int>")(F.col(text)).alias("slots")).toPandas()
    # a fixed order whatever task came first
    found["place"] = [hash(tuple(s)) for s in found["slots"]]
    found = found.sort_values(["place", "_label"], kind="stable")
    return fit([np.asarray(s, np.int64) for s in found["slots"]], found["_label"].to_numpy())


def _slots(texts: pd.Series) -> pd.Series:
    flags = np.zeros(SLOTS, bool)
    return pd.Series([features(t, flags).astype(np.int32) for t in texts], dtype=object)


def with_score(df: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        flags = np.zeros(SLOTS, bool)
        return pd.Series([sent.value.score(features(t, flags)) for t in texts], dtype="float64")

    return df.withColumn(name, F.pandas_udf(score, "double")(F.col(text)))


def held_out(key: str = "doc_id") -> Column:
    return fold(key, 3) == 1


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted."""
    model = train(docs, labels, held_out(key), key, text)
    out = with_score(docs.select(key, held_out(key).alias("held_out"), text), model, text, "score")
    return out.select(key, "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model = train(docs, labels, held_out(key), key, text)
    out = with_score(docs, model, text, "_nb_score").filter(F.col("_nb_score") >= ACCEPT)
    return out.select(*(f"`{c}`" for c in docs.columns))
