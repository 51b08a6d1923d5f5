"""Tokens to ids, windows over documents, padded batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.arrays import let
from framewise.operators.dims import join_dim
from framewise.operators.scale import ranked

UNKNOWN = "[UNK]"
LISTED_VOCAB = 200_000  # tokens that are sent to the tasks as they are
HASHED_VOCAB = 12_000_000  # tokens that are sent as hashes, 16 to 20 bytes each


def wordpiece(
    words: DataFrame, vocab: DataFrame, unknown: str = UNKNOWN, max_chars: int = 200, max_vocab: int = 500_000
) -> DataFrame:
    """Pieces of each distinct ``word`` by greedy longest match in ``vocab`` (column ``token``).

    Pieces after the first are written with ``##``. A word that cannot be covered, or
    longer than ``max_chars``, is ``unknown``. A vocabulary of up to ``max_vocab`` tokens is
    sent to the tasks and each word is followed in place. Of a larger one all substrings of a
    word meet the vocabulary in one join; then the longest match at each start is followed
    from the left.
    """
    n = F.char_length("word")
    short = words.filter(n <= max_chars)
    held = vocab.select("token").limit(max_vocab + 1).toArrow().column("token")
    if len(held) <= max_vocab:
        sent = words.sparkSession.sparkContext.broadcast(held)

        def cut(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = {t for t in sent.value.to_pylist() if t is not None}
            for column in columns:
                yield _cut_words(column, known, unknown, max_chars)

        return words.select("word", F.arrow_udf(cut, "array<string>")("word").alias("pieces"))
    # no piece is longer than the longest token
    longest_token = vocab.agg(F.max(F.char_length(F.regexp_replace("token", "^##", "")))).first()[0] or 1
    end = F.least(n, F.col("start") + (longest_token - 1))
    spans = (
        short.withColumn("start", F.explode(F.sequence(F.lit(1), n)))
        .withColumn("stop", F.explode(F.sequence(F.col("start"), end)))
        .withColumn(
            "token",
            F.concat(
                F.when(F.col("start") > 1, F.lit("##")).otherwise(F.lit("")),
                F.substring("word", F.col("start"), F.col("stop") - F.col("start") + 1),
            ),
        )
    )
    found = spans.join(vocab.select("token"), "token", "left_semi")
    longest = found.groupBy("word", "start").agg(F.max("stop").alias("stop"))
    # at most max_chars entries per word
    table = longest.groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("start", "stop"))).alias("_m")
    )
    known = words.join(table, "word", "left")
    walk = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, i: let(
            F.when(acc["at"] == i, F.try_element_at(F.col("_m"), i)),
            lambda stop: F.when(
                stop.isNotNull(),
                F.struct(
                    (stop + 1).alias("at"),
                    F.concat(
                        acc["out"],
                        F.array(
                            F.concat(
                                F.when(i > 1, F.lit("##")).otherwise(F.lit("")),
                                F.substring(F.col("word"), i, stop - i + 1),
                            )
                        ),
                    ).alias("out"),
                ),
            ).otherwise(acc),
        ),
    )
    walked = known.withColumn("_w", walk)
    complete = F.col("_m").isNotNull() & (F.col("_w.at") == n + 1)
    return walked.select(
        "word", F.when(complete, F.col("_w.out")).otherwise(F.array(F.lit(unknown))).alias("pieces")
    )


def _cut_words(words: pa.Array, known: set[str], unknown: str, max_chars: int) -> pa.Array:
    """The pieces of each word, by the longest token at every start."""
    longest = max((len(t.removeprefix("##")) for t in known), default=1)

    def cut(word: str | None) -> list[str]:
        pieces, at, n = [], 0, len(word or "")
        while at < n <= max_chars:
            for stop in range(min(n, at + longest), at, -1):
                piece = ("##" if at else "") + word[at:stop]
                if piece in known:
                    pieces.append(piece)
                    at = stop
                    break
            else:
                break
        return pieces if n and at == n else [unknown]

    return pa.array([cut(w) for w in words.to_pylist()], pa.list_(pa.string()))


def _looked_up(
    tokens: Column, vocab: DataFrame, key: str, value: str, kind: str, max_vocab: int, missing: int | None = None,
    fail: bool = False,
) -> Column | None:
    """Each list of ``tokens`` with ``key`` replaced by ``value``, inside the row.

    ``missing`` stands for what ``vocab`` lacks, which can ``fail`` the job. There is no such column for a
    vocabulary over ``max_vocab`` rows or with a repeated or NULL key.
    """
    held = vocab.select(key, value).limit(max_vocab + 1).toArrow()
    known = held.column(key).combine_chunks()
    if held.num_rows > max_vocab or known.null_count or len(known.unique()) < len(known):
        return None
    sent = vocab.sparkSession.sparkContext.broadcast(held)

    def look(lists: pa.Array) -> pa.Array:
        table, items = sent.value, lists.flatten()
        at = pc.index_in(items, value_set=table.column(key).combine_chunks().cast(items.type))
        found = table.column(value).combine_chunks().take(at)
        if fail and found.null_count:
            raise ValueError(f"not in vocabulary: {items.filter(pc.is_null(found))[0]}")
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        found = found if missing is None else found.fill_null(missing)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32), pa.int32()), found)

    return F.arrow_udf(look, f"array<{kind}>")(tokens)


def _looked_up_by_hash(tokens: Column, vocab: DataFrame, key: str, value: str, most: int, missing: int) -> Column | None:
    """`_looked_up` of whole numbers in a larger vocabulary, of which only hashes of 64 and 32 bits are sent.

    There is no such column for one over ``most`` rows, with a NULL key or with two keys of one hash.
    """
    code = F.coalesce(F.col(value), F.lit(missing)).cast("long")
    held = vocab.select(F.xxhash64(key).alias("h"), F.hash(key).alias("m"), code.alias("v"), F.col(key).isNull().alias("none"))
    held = held.limit(most + 1).toArrow()
    if held.num_rows > most or not held.num_rows or pc.any(held.column("none")).as_py():
        return None
    hashes, checks, values = (held.column(c).to_numpy() for c in "hmv")
    del held
    order = np.argsort(hashes)
    hashes, checks = hashes[order], checks[order]
    values = values[order].astype(np.int32 if np.abs(values).max() < 1 << 31 else np.int64)
    if (hashes[1:] == hashes[:-1]).any():
        return None
    sent = vocab.sparkSession.sparkContext.broadcast((hashes, checks, values))

    def look(lists: pa.Array, others: pa.Array) -> pa.Array:
        known, check, codes = sent.value
        items = lists.flatten()
        own, back = np.unique(items.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit, at = (known[at] == own)[back], at[back]
        hit &= items.is_valid().to_numpy(zero_copy_only=False)
        hit &= check[at] == others.flatten().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        found = pa.array(np.where(hit, codes[at], missing), pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32), pa.int32()), found)

    def hashed(f) -> Column:
        return F.transform(tokens, lambda x: F.when(x.isNotNull(), f(x)))

    return F.arrow_udf(look, "array<bigint>")(hashed(F.xxhash64), hashed(F.hash))


def encode(
    df: DataFrame, doc_id: str, tokens: str, vocab: DataFrame, unk: int | None = 0,
    max_vocab: int = 200_000,
) -> DataFrame:
    """Token ids of each document, in order. ``vocab`` has ``token`` and ``id``.

    With ``unk=None`` a token outside the vocabulary fails the job. A vocabulary of up to ``max_vocab``
    tokens is sent to the tasks and rows stay whole; a larger one is joined token by token.
    """
    numbered = vocab.withColumn("id", F.col("id").cast("long"))
    ids = _looked_up(F.col(tokens), numbered, "token", "id", "bigint", max_vocab, unk, unk is None)
    if ids is not None:
        return df.select(doc_id, ids.alias("ids"))
    rows = df.select(doc_id, F.posexplode(tokens).alias("pos", "token"))
    hit = join_dim(rows, vocab.select("token", "id"), ["token"], max_vocab)
    missing = (
        F.raise_error(F.concat(F.lit("not in vocabulary: "), F.col("token"))).cast("long")
        if unk is None
        else F.lit(unk).cast("long")
    )
    code = F.when(F.col("id").isNull(), missing).otherwise(F.col("id").cast("long"))
    listed = hit.groupBy(doc_id).agg(
        F.array_sort(F.collect_list(F.struct("pos", code.alias("code")))).alias("_l")
    )
    ids = listed.select(doc_id, F.transform("_l", lambda s: s["code"]).alias("ids"))
    out = df.select(doc_id).join(ids, doc_id, "left")
    return out.withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def decode(
    df: DataFrame, doc_id: str, ids: str, vocab: DataFrame, end_id: int | None = None,
    max_vocab: int = 200_000,
) -> DataFrame:
    """Text of id lists; end marks are skipped, pieces ending in ``@@`` join the next.

    A list without other ids than end marks has no row. A vocabulary of up to ``max_vocab`` tokens is
    sent to the tasks and rows stay whole; a larger one is joined id by id.
    """
    def line_of(pieces: Column) -> Column:
        line = F.array_join(pieces, " ")
        # a trailing open piece never completes a word
        return F.rtrim(F.regexp_replace(F.replace(line, F.lit("@@ "), F.lit("")), r"\S*@@$", ""))

    wanted = F.col(ids) if end_id is None else F.filter(ids, lambda i: i != end_id)
    pieces = _looked_up(F.col("_ids"), vocab, "id", "token", "string", max_vocab)
    if pieces is not None:
        return df.select(doc_id, wanted.alias("_ids")).filter(F.size("_ids") > 0).select(doc_id, line_of(pieces).alias("text"))
    rows = df.select(doc_id, F.posexplode(ids).alias("pos", "id"))
    if end_id is not None:
        rows = rows.filter(F.col("id") != end_id)
    hit = join_dim(rows, vocab.select("id", "token"), ["id"], max_vocab)
    listed = hit.groupBy(doc_id).agg(
        F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_l")
    )
    return listed.select(doc_id, line_of(F.transform("_l", lambda s: s["token"])).alias("text"))


def _step(max_len: int | Column, stride: int) -> Column:
    limit = max_len if isinstance(max_len, Column) else F.lit(max_len)
    return F.least(limit, F.lit(stride))


def window_count(n: Column, max_len: int | Column, stride: int) -> Column:
    step = _step(max_len, stride)
    more = F.ceil(F.greatest(n - max_len, F.lit(0)) / step)
    return F.when(n == 0, F.lit(0)).otherwise(more + 1).cast("long")


def doc_windows(df: DataFrame, tokens: str, max_len: int | Column, stride: int) -> DataFrame:
    """Windows over each document's tokens: ``window``, ``start``, ``length``, ``piece``.

    ``max_len`` may be a column, as the room beside a question depends on the question; a
    row without room for one token fails the job.
    """
    if isinstance(max_len, Column):
        max_len = F.when(max_len >= 1, max_len).otherwise(
            F.raise_error(F.lit("no room for a window beside the question")).cast("int")
        )
    step = _step(max_len, stride)
    n = F.size(tokens)
    count = window_count(n, max_len, stride)
    rows = df.filter(n > 0).withColumn(
        "window", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    )
    start = (F.col("window") * step).cast("int")
    rows = rows.withColumn("start", start)
    limit = max_len if isinstance(max_len, Column) else F.lit(max_len)
    rows = rows.withColumn("length", F.least(limit, F.size(tokens) - F.col("start")))
    return rows.withColumn("piece", F.slice(tokens, F.col("start") + 1, F.col("length")))


def max_context(n: Column, max_len: int, stride: int) -> Column:
    """For a document of ``n`` tokens: array with the window each token belongs to.

    The window with the largest min(left, right) + 0.01 * length, first on ties.
    Only the few windows around a token are looked at, inside the row.
    """
    step = min(max_len, stride)
    last = window_count(n, max_len, stride) - 1

    def score(p: Column, i: Column) -> Column:
        start = i * step
        length = F.least(F.lit(max_len), n - start)
        return F.least(p - start, start + length - 1 - p) + length * 0.01

    def best(p: Column) -> Column:
        low = F.greatest(F.ceil((p - max_len + 1) / step), F.lit(0)).cast("int")
        high = F.least(F.floor(p / step), last).cast("int")
        ranked_windows = F.transform(
            F.sequence(low, high), lambda i: F.struct(score(p, i).alias("s"), (-i).alias("i"))
        )
        return -F.array_max(ranked_windows)["i"]

    positions = F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0)))
    return F.when(n > 0, F.transform(positions, best))


def build_features(
    windows: DataFrame, query: Column, piece: Column, vocab: DataFrame, max_len: int,
    keys: Sequence[str], max_query: int = 64,
) -> DataFrame:
    """[CLS] query [SEP] window [SEP] as tokens, ids, mask and segments, padded with zeros.

    Windows of at most ``max_len`` - query - 3 tokens fit; a longer row fails the job. Ids are looked up inside
    the rows, in a vocabulary of over ``LISTED_VOCAB`` tokens by hashes; one over ``HASHED_VOCAB`` is joined.
    """
    q = F.slice(query, 1, max_query)
    tokens = F.concat(
        F.array(F.lit("[CLS]")), q, F.array(F.lit("[SEP]")), piece, F.array(F.lit("[SEP]"))
    )
    rows = windows.withColumn("tokens", tokens).withColumn("_q", F.size(q))
    rows = rows.withColumn("_key", F.struct(*keys))
    numbered = vocab.withColumn("id", F.col("id").cast("long"))
    ids = _looked_up(F.col("tokens"), numbered, "token", "id", "bigint", LISTED_VOCAB, 0)
    if ids is None:
        ids = _looked_up_by_hash(F.col("tokens"), numbered, "token", "id", HASHED_VOCAB, 0)
    out = rows.join(encode(rows, "_key", "tokens", vocab), "_key") if ids is None else rows.withColumn("ids", ids)
    n = F.size("tokens")

    def padded(arr: Column) -> Column:
        room = F.when(n <= max_len, F.lit(max_len) - n).otherwise(
            F.raise_error(F.lit(f"query and window are over {max_len} tokens")).cast("int")
        )
        return F.concat(arr, F.array_repeat(F.lit(0).cast("long"), room))

    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    segments = F.concat(F.array_repeat(zero, F.col("_q") + 2), F.array_repeat(one, n - F.col("_q") - 2))
    return out.select(
        *keys, "tokens", padded(F.col("ids")).alias("input_ids"),
        padded(F.array_repeat(one, n)).alias("input_mask"), padded(segments).alias("segment_ids"),
    )


def pad_batches(
    df: DataFrame, order: Sequence[str], ids: str, batch: int, n_frames: int = 1,
    target: str | None = None,
) -> DataFrame:
    """Batches of ``batch`` rows in ``order``, longest first, zero-padded to the longest.

    ``target`` names a second array, padded to the longest of the batch rounded up to
    a multiple of ``n_frames``; ``gate`` is 1 from its last real frame on.
    """
    rows = ranked(df, [], order, "_rn")
    rows = rows.withColumn("batch", F.floor((F.col("_rn") - 1) / batch)).withColumn(
        "length", F.size(ids)
    )
    # a batch is `batch` rows, however large the table is
    w = Window.partitionBy("batch")
    rows = rows.withColumn("slot", F.row_number().over(w.orderBy(F.desc("length"), "_rn")) - 1)
    rows = rows.withColumn("padded_to", F.max("length").over(w))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn(
        "padded", F.concat(ids, F.array_repeat(zero, F.col("padded_to") - F.col("length")))
    )
    if target is not None:
        size = F.size(target)
        most = F.max(size).over(w)
        up = (F.ceil(most / n_frames) * n_frames).cast("int")
        rows = rows.withColumn("target_to", up)
        fill = F.array_repeat(F.lit(0.0), F.col("target_to") - size)
        rows = rows.withColumn("target_padded", F.concat(target, fill))
        gate = F.concat(
            F.array_repeat(F.lit(0.0), size - 1),
            F.array_repeat(F.lit(1.0), F.col("target_to") - size + 1),
        )
        rows = rows.withColumn("gate", gate)
    return rows.drop("_rn")
