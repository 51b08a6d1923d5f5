"""Word bigram language model by deleted interpolation, trained on the corpus and applied to it.

P(w|u) = l2[b] c(u,w)/c(u) + l1[b] c(w)/N + l0[b] 1/(V+1), where b is the bucket of the context's
frequency (its binary logarithm). The weights of each bucket are learned by expectation-
maximisation on held-out counts: about a tenth of the training documents is deleted, the rest is
counted, and the weights maximise the probability of the deleted part. Scores then use the counts
of all training documents.

Counts are looked up by request and reply. Documents are dealt into chunks of bounded length; a
chunk asks once for each of its different words and bigrams, and the keys, cut into ranges, meet
in the task of their range, where they are added up and answered chunk by chunk. A bigram that
every document has is thus one row per chunk, whatever its frequency, no key is hot, and nothing
as large as the vocabulary is broadcast or gathered. The size of chunks and ranges bounds the
memory of a task; their number grows with the corpus.

Words and bigrams are named by hashes of 62 bits: among a thousand million words two share one
with probability 0.1. A text begins in a context of its own, which is no token, and ends with the token "end".
A word not seen in training has the probability of the uniform term. Buckets without held-out
counts take the weights of the nearest one that has some.

Cases: a NULL or empty text is the single token "end"; a NULL key is in fold 0, that is in
training; a very long text is a chunk of its own; repeated rows count and are scored as often as
they occur; ties do not arise; without training documents all counts are 0 and the weights stay
as they began; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.labelled import fold
from framewise.session import cut_lineage, discard

SEED = 42
CHUNK_CHARS = 6 << 20  # of text that one task holds
RANGE_CHARS = 6 << 20  # of text whose keys make a range, on average
RETAINED, DELETED, HELD = 0, 1, 2
DELETED_PARTS = 10  # one in so many training documents is deleted
BUCKETS = 64  # of context frequency
ROUNDS, TOLERANCE = 40, 1e-5
BEGIN, END = b"\t", b" "  # white space, so never words
KEY_BITS = 62  # of a hash; one more tells words from bigrams


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case: of bytes, so only A-Z change and only ASCII white space divides."""
    return (text or "").encode().lower().split()


class Chunk:
    """The tokens of some texts, their distinct pairs and the keys to ask for, in order."""

    def __init__(self, texts) -> None:
        names: dict[bytes, int] = defaultdict()
        names.default_factory = names.__len__
        begin, end = names[BEGIN], names[END]
        parts, sizes = [], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words) + 1)
            parts.append(np.fromiter(map(names.__getitem__, words), np.int32, len(words)))
            parts.append(np.array([end], np.int32))
        self.sizes = np.array(sizes, np.int64)
        self.token = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        context = np.empty_like(self.token)
        context[1:] = self.token[:-1]
        context[self.starts] = begin
        hashes = np.fromiter(map(hash_of, names), np.uint64, len(names))
        pair, self.of_token = np.unique(context.astype(np.int64) * len(names) + self.token, return_inverse=True)
        self.n_pair = np.bincount(self.of_token, minlength=len(pair))
        self.u, self.w = pair // len(names), pair % len(names)
        self.end = end
        mixed = hashes[self.u] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.w]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        low = np.uint64(64 - KEY_BITS)
        keys = np.concatenate([hashes >> low << np.uint64(1) | np.uint64(1), mixed >> low << np.uint64(1)])
        self.keys, self.of_key = np.unique(keys, return_inverse=True)
        n_word = np.bincount(self.token, minlength=len(names))
        n_word[begin] = len(self.sizes)
        self.counts = np.bincount(
            self.of_key, weights=np.concatenate([n_word, self.n_pair]), minlength=len(self.keys)
        ).astype(np.int64)
        self.begin_key = int(keys[begin])
        self.names = len(names)

    def split(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replies in key order as counts of the chunk's words and of its bigrams."""
        each = found[self.of_key]
        return each[: self.names], each[self.names :]


def range_starts(n: int) -> np.ndarray:
    """First keys of ``n`` ranges of equal width."""
    whole = 1 << (KEY_BITS + 1)
    return np.array([i * whole // n for i in range(n)], np.uint64)


def packed(keys: np.ndarray) -> bytes:
    """Keys of a range, less its start, in as few bytes each as the largest needs."""
    width = max(1, (int(keys[-1]).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    some = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(some), 8), np.uint8)
    out[:, :width] = some
    return out.view("<u8").ravel()


def _parts(df: DataFrame, key: str, text: str, held: Column) -> DataFrame:
    """(``_key``, ``_text``, ``_part``)."""
    # the hash of the key salted, so that the deleted tenth has nothing to do with the folds
    tenth = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("deleted")), F.lit(DELETED_PARTS)) == 0
    part = F.when(held, HELD).when(tenth, DELETED).otherwise(RETAINED)
    return df.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), part.alias("_part"))


def _chunked(parts: DataFrame, chunks: dict[int, int], size: int) -> DataFrame:
    """``parts`` with ``chunk``, the part in its last digit; rows longer than a chunk are dealt by themselves."""
    n = F.element_at(F.create_map(*(F.lit(x) for kv in chunks.items() for x in kv)), F.col("_part"))
    place = F.xxhash64("_key", "_text")
    long = F.coalesce(F.length("_text"), F.lit(0)) > size
    chunk = F.when(long, F.shiftrightunsigned(place, 8)).otherwise(F.pmod(place, n))
    return parts.withColumn("chunk", chunk * 3 + F.col("_part"))


def _requests(starts: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(pdf["_text"])
        edges = np.append(np.searchsorted(chunk.keys, starts), len(chunk.keys))
        rows = []
        for i in np.flatnonzero(np.diff(edges)):
            own = slice(edges[i], edges[i + 1])
            counts = chunk.counts[own]
            counts = counts.astype(np.min_scalar_type(counts.max()))
            rows.append((int(pdf["chunk"].iloc[0]), int(i), packed(chunk.keys[own] - starts[i]), counts.tobytes(), counts.itemsize))
        return pd.DataFrame(rows, columns=["chunk", "range", "keys", "counts", "width"])

    return run


def _replies(begin: int, starts: np.ndarray):
    """Counts of one range: for each chunk those of all training texts, and for deleted chunks
    those of the retained ones; row -1 holds the totals of the range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked(x) for x in pdf["keys"]]
        counts = [np.frombuffer(x, f"<u{w}").astype(np.int64) for x, w in zip(pdf["counts"], pdf["width"], strict=True)]
        part = pdf["chunk"].to_numpy() % 3
        sizes = np.array([len(x) for x in keys])
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts, of = np.concatenate(counts), np.repeat(part, sizes)
        retained = np.zeros(len(every), np.int64)
        trained = np.zeros(len(every), np.int64)
        np.add.at(retained, place[of == RETAINED], counts[of == RETAINED])
        np.add.at(trained, place[of != HELD], counts[of != HELD])
        ends = np.cumsum(sizes)
        rows = []
        for i, (chunk, kind) in enumerate(zip(pdf["chunk"], part, strict=True)):
            own = place[ends[i] - sizes[i] : ends[i]]
            rows.append((chunk, pdf["range"].iloc[0], trained[own], retained[own] if kind == DELETED else []))
        full = every + starts[pdf["range"].iloc[0]]
        words = (full & np.uint64(1) == 1) & (full != np.uint64(begin))
        totals = [trained[words].sum(), (trained[words] > 0).sum(), retained[words].sum(), (retained[words] > 0).sum()]
        rows.append((-1, pdf["range"].iloc[0], totals, []))
        return pd.DataFrame(rows, columns=["chunk", "range", "trained", "retained"])

    return run


def _joined(column: pd.Series) -> np.ndarray:
    return np.concatenate([np.asarray(x, np.int64) for x in column]) if len(column) else np.zeros(0, np.int64)


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for a count of 0, else 1 and the whole part of its binary logarithm."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(float))[1], 0)


def terms(n_u: np.ndarray, n_w: np.ndarray, n_uw: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of the bigram and of the word; 0 where nothing was counted."""
    return n_uw / np.maximum(n_u, 1), n_w / max(total, 1)


def _events(total: int):
    """Held-out counts: (bucket, p2, p1, n) of the bigrams of a deleted chunk."""

    def run(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"bucket": [], "p2": [], "p1": [], "n": []})
        chunk = Chunk(docs["_text"])
        words, pairs = chunk.split(_joined(replies.sort_values("range")["retained"]))
        p2, p1 = terms(words[chunk.u], words[chunk.w], pairs, total)
        out = pd.DataFrame({"bucket": bucket_of(words[chunk.u]), "p2": p2, "p1": p1, "n": chunk.n_pair})
        return out.groupby(["bucket", "p2", "p1"], as_index=False)["n"].sum()

    return run


def learned(events: DataFrame, uniform: float) -> np.ndarray:
    """Weights (uniform, word, bigram) of each bucket, by expectation-maximisation.

    One held-out count is added to every term, so no weight is ever 0. A round is one grouped
    sum over the events; only the sums of the buckets come to the driver.
    """
    spark = events.sparkSession
    weights = np.tile([0.1, 0.4, 0.5], (BUCKETS, 1))
    before = -math.inf
    seen = np.zeros(BUCKETS, bool)
    for _ in range(ROUNDS):
        table = spark.createDataFrame([(b, *map(float, w)) for b, w in enumerate(weights)], "bucket long, l0 double, l1 double, l2 double")
        each = events.join(F.broadcast(table), "bucket").withColumn("p", F.expr(f"l0 * {uniform!r}D + l1 * p1 + l2 * p2"))
        sums = each.groupBy("bucket").agg(
            F.sum(F.expr(f"n * l0 * {uniform!r}D / p")).alias("a"), F.sum(F.expr("n * l1 * p1 / p")).alias("b"),
            F.sum(F.expr("n * l2 * p2 / p")).alias("c"), F.sum(F.expr("n * ln(p)")).alias("ll"), F.sum("n").alias("n"),
        ).collect()
        for r in sums:
            share = np.array([r.a, r.b, r.c]) + 1
            weights[r.bucket], seen[r.bucket] = share / share.sum(), True
        n, likely = sum(r.n for r in sums), sum(r.ll for r in sums)
        if not n or likely - before < TOLERANCE * n:
            break
        before = likely
    known = np.flatnonzero(seen)
    if len(known):
        weights = weights[[known[np.abs(known - b).argmin()] for b in range(BUCKETS)]]
    return weights


def _scores(total: int, kinds: int, weights: np.ndarray):
    def run(docs: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"_key": [], "held_out": [], "n_tokens": [], "n_known": [], "base": [], "score": []})
        chunk = Chunk(docs["_text"])
        words, pairs = chunk.split(_joined(replies.sort_values("range")["trained"]))
        n_u, n_w = words[chunk.u], words[chunk.w]
        p2, p1 = terms(n_u, n_w, pairs, total)
        own = weights[bucket_of(n_u)]
        each = np.log10(own[:, 0] / (kinds + 1) + own[:, 1] * p1 + own[:, 2] * p2)
        base = np.log10((words + 1) / (total + kinds + 1))
        add = np.add.reduceat
        return pd.DataFrame({
            "_key": docs["_key"], "held_out": docs["_part"] == HELD, "n_tokens": chunk.sizes,
            "n_known": add((words > 0).astype(np.int64)[chunk.token], chunk.starts),
            "base": add(base[chunk.token], chunk.starts), "score": add(each[chunk.of_token], chunk.starts),
        })

    return run


def scored(
    df: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None,
    chunk_chars: int = CHUNK_CHARS, range_chars: int = RANGE_CHARS,
) -> DataFrame:
    """Per document: key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``held`` marks the documents that are not learned from: by default those with crc32 of the
    key as text in remainder 2 of 7. ``base_score`` is the add-one unigram score.
    """
    spark = df.sparkSession
    parts = _parts(df, key, text, fold(key, 7) == 2 if held is None else held)
    sizes = {
        r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.sum(F.coalesce(F.length("_text"), F.lit(0)) + 1).alias("n")).collect()
    }
    total_chars = sum(sizes.values())
    cores = spark.sparkContext.defaultParallelism
    size = max(1 << 16, min(chunk_chars, total_chars // (2 * cores) + 1))
    chunks = {part: 1 + n // size for part, n in sizes.items()} or {RETAINED: 1}
    starts = range_starts(1 + total_chars // max(1 << 16, min(range_chars, total_chars // (2 * cores) + 1)))
    docs = _chunked(parts, chunks, size)
    asked = docs.select("chunk", "_text").groupBy("chunk").applyInPandas(
        _requests(starts), "chunk long, range int, keys binary, counts binary, width int"
    )
    begin = int(np.uint64(hash_of(BEGIN)) >> np.uint64(64 - KEY_BITS) << np.uint64(1) | np.uint64(1))
    replies = cut_lineage(
        asked.groupBy("range").applyInPandas(
            _replies(begin, starts), "chunk long, range int, trained array<long>, retained array<long>"
        )
    )
    sums = [F.coalesce(F.sum(F.get("trained", i)), F.lit(0)).alias(f"s{i}") for i in range(4)]
    total, kinds, total_retained, kinds_retained = replies.filter("chunk = -1").agg(*sums).first()
    deleted = docs.filter(F.col("_part") == DELETED).select("chunk", "_text").groupBy("chunk")
    answered = replies.filter(F.pmod("chunk", F.lit(3)) == DELETED).select("chunk", "range", "retained")
    raw = deleted.cogroup(answered.filter("chunk >= 0").groupBy("chunk")).applyInPandas(
        _events(total_retained), "bucket long, p2 double, p1 double, n long"
    )
    events = cut_lineage(raw.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")))
    weights = learned(events, 1.0 / (kinds_retained + 1))
    discard(events)
    final = docs.select("chunk", "_key", "_text", "_part").groupBy("chunk").cogroup(
        replies.filter("chunk >= 0").select("chunk", "range", "trained").groupBy("chunk")
    )
    key_type = df.schema[key].dataType.simpleString()
    out = final.applyInPandas(
        _scores(total, kinds, weights),
        "_key string, held_out boolean, n_tokens long, n_known long, base double, score double",
    )
    return out.select(
        F.col("_key").cast(key_type).alias(key), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
