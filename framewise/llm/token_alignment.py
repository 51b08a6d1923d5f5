"""Alignment of two tokenizers over a corpus: which tokens of one stand for which of the other.

A is a byte-level BPE vocabulary, B a SentencePiece model. Byte offsets where tokens of both end
cut a text into groups; within a group every A token is linked with every B token, and an id pair
counts once for each document that has it linked.

Equal texts are found by a shuffle on the full text, and each different text is encoded and
aligned once; its pairs weigh as many documents as hold it. Measures go back to the documents by
the SHA-256 of the text. The counts of pairs are looked up in two ways that together are exact:
the most frequent pairs, at most ``FREQUENT`` of them, are broadcast to the tasks that hold the
texts' pairs, and the pairs below that frequency are joined as rows, so no join has a hot pair.

A text whose joined tokens do not give blank + text back (U+2581 in it, as B writes a blank so)
has no tokens. Cases: a NULL or empty text has none either: zeros and ''; special tokens in a text
are plain text; a very long text is one slice, and pairs of a very long group are taken in slices
of bounded length; equally frequent pairs are all the best of their A id; repeated rows are
documents of their own; NULL keys are kept; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.sp_tokens import BYTE, MARK, MODEL_PATH, UNKNOWN, parse, read_model, slices
from framewise.session import cut_lineage, discard

BYTE_BPE_PATH = "/opt/tokenizers/byte_bpe_50k.json"
FREQUENT = 1 << 20  # pairs that are broadcast, at most
MOST_LINKS = 1 << 20  # of one text that are held at once
# fixed value: how byte-level BPE cuts a text before merging
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 characters
    for themselves, the other bytes in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A: a tokenizers JSON file, run by tiktoken where ids follow the order of merges."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if (model["type"], cut["type"], cut["add_prefix_space"]) != ("BPE", "ByteLevel", False) or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        self.other = Tokenizer.from_str(data.decode())
        self.other.encode_special_tokens = True
        places, special = byte_of_character(), {t["content"] for t in spec["added_tokens"]}
        vocab = {p: i for p, i in model["vocab"].items() if p not in special}
        self.bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for piece, i in vocab.items():
            self.bytes[i] = bytes(places[c] for c in piece)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        in_order = [vocab[m] for m in merged]
        self.fast = None
        if in_order == sorted(in_order) and not model.get("ignore_merges"):
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocab.values()}
            self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> list[int]:
        return self.other.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if self.fast is None:
            return self.slow(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as err:  # its pattern gives up on some long runs of white space
            if type(err).__name__ != "PanicException":
                raise
            return self.slow(text)


class Pieces:
    """Tokenizer B: a SentencePiece model."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode()
            for p in parse(data).pieces
        ]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    def __init__(self, a: bytes, b: bytes) -> None:
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.sizes_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.sizes_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.names_a = np.array([f"{i}{c}" for i in range(len(self.sizes_a)) for c in ",|"], object)
        self.names_b = np.array([f"{i}{c}" for i in range(len(self.sizes_b)) for c in ",;"], object)

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both; None unless both give the text back."""
        given = " " + text
        a, b, want = self.a.encode(given), self.b.encode(text), given.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != want or b"".join(map(self.b.bytes.__getitem__, b)) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, text: str) -> tuple[tuple, np.ndarray, np.ndarray]:
        """(measures, pair codes a * |B| + b, number of links of each) of one text."""
        none = np.zeros(0, np.int64)
        both = self.encoded(text) if text else None
        if both is None:
            return (0, 0, 0, 0, ""), none, none
        a, b = both
        end_a, end_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        codes, links = self.pairs(a, b, in_a, in_b)
        spelled = np.empty(len(a) + len(b), object)
        last_a, last_b = np.diff(of_a, append=len(cuts)) > 0, np.diff(of_b, append=len(cuts)) > 0
        spelled[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[of_a]] = self.names_a[2 * a + last_a]
        spelled[np.arange(len(b)) + np.cumsum(in_a)[of_b]] = self.names_b[2 * b + last_b]
        digest = hashlib.sha256("".join(spelled.tolist())[:-1].encode()).hexdigest()
        return (len(a), len(b), len(cuts), int((in_a * in_b).sum()), digest), codes, links

    def pairs(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different pair codes of the groups with their number of links."""
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        wide = np.flatnonzero(in_a * in_b > MOST_LINKS)
        found = [
            self._product(a[start_a[g] : start_a[g] + in_a[g]], b[start_b[g] : start_b[g] + in_b[g]]) for g in wide
        ]
        of_a = np.repeat(np.arange(len(in_a)), in_a)
        each = np.where(in_a * in_b > MOST_LINKS, 0, in_b)[of_a]  # links of each A token
        before = np.cumsum(each) - each
        first = 0
        while first < len(a):
            end = max(first + 1, int(np.searchsorted(before, before[first] + MOST_LINKS)))
            own = each[first:end]
            at = np.arange(own.sum()) - np.repeat(before[first:end] - before[first], own)
            codes = np.repeat(a[first:end], own) * len(self.sizes_b) + b[np.repeat(start_b[of_a[first:end]], own) + at]
            found.append(np.unique(codes, return_counts=True))
            first = end
        return _added(found)

    def _product(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a group with very many links, from its different ids."""
        (a, n_a), (b, n_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        return (a[:, None] * len(self.sizes_b) + b).ravel(), (n_a[:, None] * n_b).ravel()


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(found) == 1:
        return found[0]
    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    links = np.zeros(len(codes), np.int64)
    np.add.at(links, at, np.concatenate([n for _, n in found]))
    return codes, links


@cache
def aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _align(a, b):
    names = ["digest", "docs", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a.value, b.value)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(0).to_pylist()):
                measures, codes, links = zip(*map(own.align, texts), strict=True)
                kinds = [pa.int64()] * 4 + [pa.string()]
                made = [pa.array(c, t) for c, t in zip(zip(*measures, strict=True), kinds, strict=True)]
                kept = [c.slice(at, len(texts)) for c in batch.columns[1:]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*kept, *made, _lists(codes), _lists(links)], names=names)

    return run


def aligned_texts(df: DataFrame, text: str, a, b) -> DataFrame:
    """One row per different text: its digest, how many rows hold it, its measures and its pairs."""
    different = df.select(F.col(text).alias("t")).filter("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("docs"))
    given = different.select("t", F.unhex(F.sha2("t", 256)).alias("digest"), "docs")
    out = given.mapInArrow(_align(a, b), f"digest binary, docs long, {MEASURES}, codes array<long>, links array<long>")
    return cut_lineage(out.withColumn("tid", F.monotonically_increasing_id()))


def pair_counts(texts: DataFrame, b_size: int) -> DataFrame:
    """(code, n, best): in how many documents an id pair is linked, and whether no other pair of
    its A id is linked in more. The best counts are as many as A has ids."""
    counts = cut_lineage(texts.select("docs", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("docs").alias("n")))
    a = F.floor(F.col("code") / b_size).alias("a")
    best = counts.groupBy(a).agg(F.max("n").alias("top"))
    marked = counts.withColumn("a", a).join(F.broadcast(best), "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    out = cut_lineage(marked)
    discard(counts)
    return out


def frequent_from(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs reach."""
    steps = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    total, least = 0, (1 << 63) - 1
    for r in sorted(steps, key=lambda r: -r.bits):
        total += r.pairs
        if total > most:
            break
        least = 1 << (r.bits - 1)
    return least if steps else 1


def _look_up(frequent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = frequent.value
        for batch in batches:
            codes, links = batch.column(0), batch.column(1)
            ends = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy())]).astype(np.int64)
            code, link = codes.flatten().to_numpy(), links.flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            hit = known[at] == code if len(known) else np.zeros(len(code), bool)
            at, weight = np.where(hit, at, 0), np.where(hit, link, 0)
            sums = [np.concatenate([[0], np.cumsum(weight * (x[at] if len(x) else 0))]) for x in (n, best)]
            left = np.concatenate([[0], np.cumsum(~hit)]).astype(np.int32)[ends]
            made = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
            made += [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])) for x in (code, link)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=names)

    return run


def aligned(
    df: DataFrame, key: str = "doc_id", text: str = "text", a_path: str = BYTE_BPE_PATH, b_path: str = MODEL_PATH,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per document: key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    sc = df.sparkSession.sparkContext
    data = read_model(a_path), read_model(b_path)
    a, b = map(sc.broadcast, data)
    texts = aligned_texts(df, text, a, b)
    counts = pair_counts(texts, len(parse(data[1]).pieces))
    least = frequent_from(counts, frequent)
    top = counts.filter(F.col("n") >= least).orderBy("code").toPandas()  # at most ``frequent`` rows
    sent = sc.broadcast((top["code"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)))
    carried = ["digest", "tid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = f"digest binary, tid long, {MEASURES}, count_sum long, n_best long, codes array<long>, links array<long>"
    found = texts.select("codes", "links", *carried).mapInArrow(
        _look_up(sent, [*carried, "count_sum", "n_best", "codes", "links"]), schema
    )
    if least > 1:
        found = cut_lineage(found)
        pairs = found.select("tid", F.explode(F.arrays_zip("codes", "links")).alias("p")).select("tid", "p.codes", "p.links")
        rare = pairs.join(counts.filter(F.col("n") < least), F.col("codes") == F.col("code"))
        rest = rare.groupBy("tid").agg(
            F.sum(F.col("links") * F.col("n")).alias("more"), F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best")
        )
        found = found.join(rest, "tid", "left").withColumns({
            "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        })
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    docs = df.select(F.col(key).alias("_key"), F.when(F.col(text) != "", F.unhex(F.sha2(F.col(text), 256))).alias("digest"))
    return docs.join(found.select("digest", "groups_sha256", *numbers), "digest", "left").select(
        F.col("_key").alias(key), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
