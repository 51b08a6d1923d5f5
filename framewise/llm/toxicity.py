"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are made from labelled text: one of segments (short runs of bytes in words) that
are far more frequent in toxic documents than in ordinary ones, one the other way round. A window
of a few words is compressed with either. Where the toxic dictionary saves bytes against the
ordinary one, at least the window threshold, the window counts; a document's score grows with the
bytes saved per word. Both thresholds are calibrated on all labelled texts.

Markers differ: some stand in toxic texts only and one is enough, others stand in ordinary texts
too and only their share of the words tells. A second pair of dictionaries is therefore learnt from
the toxic texts that the first pair leaves unmarked, with longer segments chosen by how often they
occur among the words, and has thresholds of its own; it is used if the labelled texts are separated
better with it. A text has the larger score of the two.

What made this work on short windows: segments are chosen by greedy cover (the one that marks
most documents not yet marked ``COVER`` times comes first), so a dictionary holds what tells the
classes apart and little else; segments are divided by a byte that no text has, so no match
crosses two of them; and window and dictionaries share a fixed carrier, because zstandard stores
a block as it is when it saves too little, which would hide single matches. Only windows that have a
run of ``SEGMENT`` bytes in common with the toxic dictionary are compressed, as in all others it has no
match and saves nothing.

Labels come only from rows that are not held out, and all of those are learnt from: segments are
counted, dictionaries covered and thresholds set over the whole table of them. Only candidate
segments, their cover counts and thresholds come to the driver, which is of bounded size. Cases: NULL and empty texts have score 0; equal texts get equal
scores; without labels of both classes every score is 0; a NULL key is never a label's; an empty
table gives no rows; further columns are not carried; words of any length are read to their end, as
windows of more than ``MOST_BYTES`` are compressed in overlapping parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.labelled import fold, labelled_texts
from framewise.llm.words import count_words
from framewise.operators.scale import running
from framewise.session import cut_lineage, discard

SEGMENT = 5  # bytes
LONG_SEGMENT = 8  # bytes, of the second pair
WINDOW = 6  # words
MOST_BYTES = 192  # of a window that is compressed at once
COVER = 3
MIN_DOCS = 8
MIN_RATIO = 100.0
WORD_RATIO = 20.0  # of occurrences per word, for the second pair
MOST_TIMES = 8  # occurrences in one text that count
MOST_SEGMENTS = 4096  # candidates per class, the commonest
MOST_CHOSEN = 256
BLOCK = 64  # segments that one round of the cover chooses among
MOST_KINDS = 200_000  # rows of one round; any 16 segments have fewer subsets
BUCKETS = 1 << 16  # of segments, as many as `_short` has values
MOST_COUNTED = 2_000_000  # segments that a task holds while it counts
LEVEL = 9
MOST_CUT = 8  # bytes
CUT = 0.3
SMOOTH_WORDS = 20
CARRIER = b"0Qz7#Kx9~Wv3@Jy5^Hb1_Gd8=Fm2+Lp6%Rt4;Nc0?Ts"
DIVIDER = b"\x01"


def flattened(text: str | None) -> tuple[bytes, int]:
    """The words of a text, each with a blank before it, and their number.

    Windows lie one after the other in it.
    """
    words = (text or "").encode().split()
    return (b" " + b" ".join(words) if words else b""), len(words)


def runs(flat: bytes, size: int) -> np.ndarray:
    """All runs of ``size`` bytes (8 at most) as numbers that sort like the bytes."""
    n = max(0, len(flat) - size + 1)
    whole = np.ndarray((n,), ">u8", flat + bytes(8), strides=(1,)).astype(np.uint64)
    return whole >> np.uint64(64 - 8 * size)


class Runs:
    """The runs of a text, and 16 bits of each to pass over most that are not looked for."""

    def __init__(self, flat: bytes, size: int) -> None:
        self.numbers = runs(flat, size)
        self.short = _short(self.numbers)


def _short(numbers: np.ndarray) -> np.ndarray:
    return ((numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.intp)


class Known:
    """Runs that are looked for."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers = np.unique(numbers)
        self.maybe = np.zeros(BUCKETS, bool)
        self.maybe[_short(self.numbers)] = True

    def among(self, found: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Where in the text known runs are, and which ones."""
        at = np.flatnonzero(self.maybe[found.short])
        if not len(at):
            return at, at
        there = found.numbers[at]
        place = np.minimum(np.searchsorted(self.numbers, there), len(self.numbers) - 1)
        same = self.numbers[place] == there
        return at[same], place[same]


def segments(text: str | None, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` bytes inside the words of a text, and how many words have them.

    A word has a blank before it.
    """
    flat, _ = flattened(text)
    found = runs(flat, size)
    blanks = np.cumsum(np.frombuffer(flat, np.uint8) == 32)
    first = blanks[: len(found)]
    inside = blanks[size - 1 :] == first if len(found) else np.zeros(0, bool)
    found, word = found[inside], first[inside]
    order = np.argsort(found, kind="stable")
    found, word = found[order], word[order]
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    start = np.flatnonzero(new)
    once = new.copy()
    once[1:] |= word[1:] != word[:-1]
    times = np.add.reduceat(once.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    return found[start], times


def frequent_buckets(texts: DataFrame, text: str, least: dict[int, int], size: int = LONG_SEGMENT) -> np.ndarray:
    """For each bucket of segments (`_short`), whether one of them may occur ``least[c]`` times in
    class c: the whole bucket does. Each task adds up its texts, so few rows leave it."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for label, value in zip(batch["_label"], batch["_text"], strict=True):
                own, times = segments(value, size)
                total = sums.setdefault(label, np.zeros(BUCKETS, np.int64))
                np.add.at(total, _short(own), np.minimum(times, MOST_TIMES))
        for label, total in sums.items():
            yield pd.DataFrame({"label": [label], "o": [total]})

    rows = texts.select("_label", F.col(text).alias("_text")).mapInPandas(add, "label int, o array<long>")
    sums = rows.select("label", F.posexplode("o").alias("bucket", "o")).groupBy("label", "bucket").agg(F.sum("o").alias("o"))
    enough = F.col("o") >= F.when(F.col("label") == 1, least[1]).otherwise(least[0])
    out = np.zeros(BUCKETS, bool)
    out[[r["bucket"] for r in sums.filter(enough).select("bucket").distinct().collect()]] = True
    return out


def segment_counts(texts: DataFrame, text: str, size: int = SEGMENT, buckets: np.ndarray | None = None) -> DataFrame:
    """(segment, n0, n1, o0, o1): in how many texts of each class a segment occurs, and
    how often, a text counting ``MOST_TIMES`` times at most; a segment is a number as of `runs`.

    With ``buckets`` only segments of these are counted.
    """

    def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held, n, o = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(held, kind="stable")
        held = held[order]
        start = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        return held[start], np.add.reduceat(n[order], start), np.add.reduceat(o[order], start)

    def table(label: int, part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"segment": part[0].view(np.int64), "n": part[1], "o": part[2], "label": label})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, list] = {0: [], 1: []}
        held = {0: 0, 1: 0}
        for batch in batches:
            for label, value in zip(batch["_label"], batch["_text"], strict=True):
                own, times = segments(value, size)
                if buckets is not None:
                    kept = buckets[_short(own)]
                    own, times = own[kept], times[kept]
                if not len(own):
                    continue
                parts[label].append((own, np.ones(len(own), np.int64), np.minimum(times, MOST_TIMES)))
                held[label] += len(own)
                if held[label] > MOST_COUNTED:
                    parts[label] = [summed(parts[label])]
                    held[label] = len(parts[label][0][0])
                    if held[label] > MOST_COUNTED // 2:
                        yield table(label, parts[label][0])
                        parts[label], held[label] = [], 0
        for label in (0, 1):
            if parts[label]:
                yield table(label, summed(parts[label]))

    rows = texts.select("_label", F.col(text).alias("_text"))
    partial = rows.mapInPandas(count, "segment long, n long, o long, label int")
    return partial.groupBy("segment").agg(
        *(
            F.coalesce(F.sum(F.when(F.col("label") == c, F.col(v))), F.lit(0)).alias(f"{v}{c}")
            for v in ("n", "o") for c in (0, 1)
        )
    )


def pieces(window: bytes) -> Iterator[bytes]:
    """A window in parts of at most ``MOST_BYTES``, as zstandard sees a dictionary only that near.

    Each part begins with the end of the one before, so every segment is whole in one of them.
    """
    yield window[:MOST_BYTES]
    for i in range(MOST_BYTES, len(window), MOST_BYTES - LONG_SEGMENT + 1):
        start = i - LONG_SEGMENT + 1
        yield window[start : start + MOST_BYTES]


def cover(owners: list[list[int]], n_segments: int, times: int = COVER, most: int = MOST_CHOSEN) -> list[int]:
    """Segments by greedy cover: each text wants ``times`` of its own; ties to the earlier one."""
    holders: list[list[int]] = [[] for _ in range(n_segments)]
    for text, own in enumerate(owners):
        for s in own:
            holders[s].append(text)
    arrays = [np.asarray(h, np.int64) for h in holders]
    wanted = np.full(len(owners), times)
    chosen: list[int] = []
    open_ = set(range(n_segments))
    while open_ and len(chosen) < most:
        best = max(open_, key=lambda s: (int((wanted[arrays[s]] > 0).sum()), -s))
        if (wanted[arrays[best]] > 0).sum() < 2:
            break
        chosen.append(best)
        open_.remove(best)
        wanted[arrays[best]] -= 1
    return chosen


def cover_texts(owners: DataFrame, times: int = COVER, most: int = MOST_CHOSEN) -> list[int]:
    """`cover` of a table of texts (``s``: their segments in order), with the same choice.

    A round counts for each segment the texts that want it, takes the ``BLOCK`` most wanted ones and
    counts the texts by which of those they have. A segment only loses by the choice of others, so
    from these counts the round chooses until one outside the block may be as good.
    """
    kinds = cut_lineage(owners.filter(F.size("s") > 0).groupBy("s").agg(F.count(F.lit(1)).alias("n")))
    chosen: list[int] = []
    while len(chosen) < most:
        taken = F.array(*map(F.lit, chosen)).cast("array<int>")
        want = F.lit(times) - F.size(F.array_intersect("s", taken))
        open_ = kinds.select(F.array_except("s", taken).alias("s"), want.alias("w"), "n").filter("w > 0")
        found = open_.select(F.explode("s").alias("s"), "n").groupBy("s").agg(F.sum("n").alias("n")).collect()
        ranked = sorted((-r["n"], r["s"]) for r in found)
        new = _chosen_of_block(open_, ranked, most - len(chosen))
        chosen += new
        if not new:
            break
    discard(kinds)
    return chosen


def _chosen_of_block(open_: DataFrame, ranked: list[tuple[int, int]], most: int) -> list[int]:
    """What the cover takes next, as far as the head of ``ranked`` (-texts, segment) tells."""
    size = BLOCK
    while True:
        block = sorted(s for _, s in ranked[:size])
        own = F.array_intersect("s", F.array(*map(F.lit, block)).cast("array<int>"))
        counts = open_.groupBy(own.alias("own"), "w").agg(F.sum("n").alias("n")).filter(F.size("own") > 0)
        rows = counts.limit(MOST_KINDS + 1).collect()
        if len(rows) <= MOST_KINDS:
            break
        size //= 2
    outside = ranked[size] if len(ranked) > size else (0, 0)
    place = {s: i for i, s in enumerate(block)}
    has = np.zeros((len(rows), len(block)), bool)
    for i, r in enumerate(rows):
        has[i, [place[s] for s in r["own"]]] = True
    wanted = np.array([r["w"] for r in rows], np.int64)
    n = np.array([r["n"] for r in rows], np.int64)
    out: list[int] = []
    while place and len(out) < most:
        gains = np.where(wanted > 0, n, 0) @ has
        best = min((-int(gains[i]), s) for s, i in place.items())
        if best > outside or best[0] > -2:
            break
        out.append(best[1])
        wanted[has[:, place.pop(best[1])]] -= 1
    return out


@dataclass
class Model:
    """Two dictionaries and two thresholds; compressors are made where they are used.

    ``second`` is the pair for what this one leaves unmarked.
    """

    toxic: bytes
    ordinary: bytes
    window_cut: int = 1
    rate_cut: float = 1.0
    second: Model | None = None
    _pair: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> tuple:
        return self.toxic, self.ordinary, self.window_cut, self.rate_cut, self.second

    def __setstate__(self, state: tuple) -> None:
        self.toxic, self.ordinary, self.window_cut, self.rate_cut, self.second = state
        self._pair = None

    def gains(self, text: str | None) -> list[int]:
        """Bytes that the toxic dictionary saves against the ordinary one, per window that has a
        run of the toxic one."""
        flat, _ = flattened(text)
        return self._gains(flat, Runs(flat, SEGMENT))

    def _gains(self, flat: bytes, found: Runs) -> list[int]:
        if self._pair is None:
            self._pair = (_compressor(self.ordinary), _compressor(self.toxic), Known(runs(self.toxic, SEGMENT)))
        ordinary, toxic, known = self._pair
        at, _ = known.among(found)
        if not len(at):
            return []
        starts = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)[::WINDOW]
        ends = np.append(starts[1:], len(flat))
        out = []
        for i in np.unique(np.searchsorted(starts, at, side="right") - 1):
            for piece in pieces(flat[starts[i] : ends[i]]):
                window = CARRIER + piece
                out.append(len(ordinary.compress(window)) - len(toxic.compress(window)))
        return out

    def rate(self, gains: list[int], n_words: int) -> float:
        """Saved bytes per word over the windows that count."""
        saved = sum(g for g in gains if g >= self.window_cut)
        return saved / (n_words + SMOOTH_WORDS)

    def score(self, text: str | None) -> float:
        """0 to 1; ``CUT`` at the calibrated rate."""
        flat, n_words = flattened(text)
        return self._score(flat, n_words, Runs(flat, SEGMENT))

    def _score(self, flat: bytes, n_words: int, found: Runs) -> float:
        other = self.second._score(flat, n_words, found) if self.second else 0.0
        if not flat or not self.toxic:
            return other
        rate = self.rate(self._gains(flat, found), n_words)
        return max(other, rate / (rate + self.rate_cut * (1 - CUT) / CUT))


def _compressor(segments_: bytes) -> zstandard.ZstdCompressor:
    content = segments_ + DIVIDER * 8 + CARRIER
    shape = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=256, dict_size=len(content), min_match=SEGMENT, write_content_size=False,
        write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=shape)


def _telling(sizes: dict[int, int], label: int) -> Column:
    """Segments that nearly only one class has."""
    own, other = F.col(f"n{label}"), F.col(f"n{1 - label}")
    share, rest = own / sizes[label], (other + 0.5) / sizes[1 - label]
    # among few texts one chance occurrence in the other class must not hide a segment
    return (own >= MIN_DOCS) & (share > F.least(F.lit(MIN_RATIO) * rest, F.lit(0.2))) & (other <= 0.02 * own)


def _frequent(words: dict[int, int], label: int) -> Column:
    """Segments that are far more frequent among the words of one class."""
    own, other = F.col(f"o{label}"), F.col(f"o{1 - label}")
    rest = (other + 0.5) / max(1, words[1 - label])
    return (F.col(f"n{label}") >= MIN_DOCS) & (own / max(1, words[label]) > WORD_RATIO * rest)


def _least(words: dict[int, int], label: int) -> int:
    """How often a segment of `_frequent` occurs at least."""
    return max(MIN_DOCS, int(WORD_RATIO * 0.5 * words[label] / max(1, words[1 - label])))


def _dictionary(texts: DataFrame, counts: DataFrame, telling: Column, text: str, label: int, size: int) -> bytes:
    """The dictionary of one class: its telling segments, the best ones last (nearest)."""
    own, other = F.col(f"n{label}"), F.col(f"n{1 - label}")
    name = F.lpad(F.hex("segment"), 2 * size, "0").alias("name")
    rows = counts.filter(telling).orderBy(own.desc(), other, name).limit(MOST_SEGMENTS).select(name).collect()
    names = [bytes.fromhex(r["name"]) for r in rows]
    if not names:
        return b""
    numbers = np.array([int.from_bytes(n, "big") for n in names], np.uint64)
    known, order = Known(numbers), np.argsort(numbers)

    def owned(values: pd.Series) -> pd.Series:
        # a segment has a blank at its begin only, so a run that equals it lies inside a word
        found = (known.among(Runs(flattened(t)[0], size))[1] for t in values)
        return pd.Series([np.sort(order[np.unique(f)]) for f in found], dtype=object)

    mine = texts.filter(F.col("_label") == label)
    chosen = cover_texts(mine.select(F.pandas_udf(owned, "array<int>")(F.col(text)).alias("s")))
    return DIVIDER.join(names[i] for i in reversed(chosen))


def train(
    docs: DataFrame, labels: DataFrame, held: Column, key: str = "doc_id", text: str = "text",
    label: str = "toxic",
) -> Model:
    """Dictionaries and thresholds from all labelled texts that are not held out."""
    known = cut_lineage(labelled_texts(docs, labels, label, held, key, text).select("_label", text))
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return Model(b"", b"")
    counts = cut_lineage(segment_counts(known, text))
    model = Model(*(_dictionary(known, counts, _telling(sizes, c), text, c, SEGMENT) for c in (1, 0)))
    discard(counts)
    if model.toxic:
        model = calibrated(model, known, text)
    model = with_second(model, known, text)
    discard(known)
    return model


def with_second(model: Model, texts: DataFrame, text: str) -> Model:
    """``model`` with a second pair for the texts it leaves unmarked, if that separates better."""
    rest = cut_lineage(texts.filter(~_marked(model, texts, text)))
    second = _second(rest, text)
    discard(rest)
    if second is None:
        return model
    both = Model(model.toxic, model.ordinary, model.window_cut, model.rate_cut, second)
    return both if _f1(both, texts, text) > _f1(model, texts, text) else model


def _second(rest: DataFrame, text: str) -> Model | None:
    """The pair of long segments, chosen by how often they occur; None where there is none."""
    found = rest.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.sum(count_words(F.col(text))).alias("w")).collect()
    sizes, words = ({r["_label"]: r[c] for r in found} for c in ("n", "w"))
    if set(sizes) != {0, 1} or sizes[1] < MIN_DOCS:
        return None
    buckets = frequent_buckets(rest, text, {c: _least(words, c) for c in (0, 1)})
    counts = cut_lineage(segment_counts(rest, text, LONG_SEGMENT, buckets))
    second = Model(*(_dictionary(rest, counts, _frequent(words, c), text, c, LONG_SEGMENT) for c in (1, 0)))
    discard(counts)
    return calibrated(second, rest, text) if second.toxic else None


def _marked(model: Model, texts: DataFrame, text: str) -> Column:
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def marked(values: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) >= CUT for t in values], dtype="bool")

    return F.pandas_udf(marked, "boolean")(F.col(text))


def _f1(model: Model, texts: DataFrame, text: str) -> float:
    """F1 on the labelled texts."""
    rows = texts.select("_label", _marked(model, texts, text).cast("int").alias("m")).groupBy("_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("m").alias("m")
    )
    n, marked = ({r["_label"]: r[c] for r in rows.collect()} for c in ("n", "m"))
    return 2 * marked[1] / (marked[1] + marked[0] + n[1])


def calibrated(model: Model, texts: DataFrame, text: str) -> Model:
    """Set the saving from which a window counts and the rate from which a text is toxic.

    Of the savings up to ``MOST_CUT`` the one is taken that, with its best rate, separates the
    labelled texts best; the smaller one on ties.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def savings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for label, value in zip(batch["_label"], batch["_text"], strict=True):
                flat, words = flattened(value)
                gains = sent.value._gains(flat, Runs(flat, SEGMENT))
                saved = [sum(g for g in gains if g >= cut) for cut in range(1, MOST_CUT + 1)]
                rows.append((label, words, saved))
            yield pd.DataFrame(rows, columns=["label", "words", "saved"])

    kinds = "label int, words long, saved array<long>"
    found = cut_lineage(texts.select("_label", F.col(text).alias("_text")).mapInPandas(savings, kinds))
    toxic = found.filter("label = 1").count()
    each = found.select("label", "words", F.posexplode("saved").alias("cut", "saved"))
    rates = each.select("label", F.col("cut") + 1, F.col("saved") / (F.col("words") + SMOOTH_WORDS))
    cut, rate = best_cut_of_table(rates.toDF("label", "cut", "rate"), toxic)
    discard(found)
    return Model(model.toxic, model.ordinary, cut, rate)


def best_cut_of_table(rates: DataFrame, toxic: int) -> tuple[int, float]:
    """`best_cut` of a table (label, cut, rate) for each ``cut``: the cut with the best F1, the
    smaller one on ties, and its value; ``toxic`` is the number of texts with label 1."""
    ones = F.sum((F.col("label") == 1).cast("long")).alias("n1")
    zeros = F.sum((F.col("label") != 1).cast("long")).alias("n0")
    counts = cut_lineage(rates.filter("rate > 0").groupBy("cut", "rate").agg(ones, zeros))
    sums = {"hits": ("sum", F.col("n1")), "false": ("sum", F.col("n0"))}
    f1 = 2 * F.col("hits") / (F.col("hits") + F.col("false") + max(1, toxic))
    best = running(counts, ["cut"], ["-rate"], sums).orderBy(f1.desc(), "cut", F.col("rate").desc()).first()
    if best is None:
        return 1, 1.0
    below = counts.filter((F.col("cut") == best["cut"]) & (F.col("rate") < best["rate"])).agg(F.max("rate")).first()[0]
    discard(counts)
    return int(best["cut"]), (best["rate"] + (below or 0.0)) / 2


def best_cut(values: np.ndarray, labels: np.ndarray, weight: float = 1.0) -> tuple[float, float]:
    """The value above 0 at which "at least this" has the best F1, and that F1.

    Label 0 weighs ``weight``; the value lies between two neighbours.
    """
    order = np.argsort(-values, kind="stable")
    sorted_, hits = values[order], np.cumsum(labels[order] == 1)
    false = np.cumsum(labels[order] != 1) * weight
    f1 = 2 * hits / (hits + false + max(1, (labels == 1).sum()))
    last = np.append(sorted_[1:] < sorted_[:-1], True) & (sorted_ > 0)
    if not last.any():
        return 1.0, 0.0
    at = int(np.flatnonzero(last)[np.argmax(f1[last])])
    below = sorted_[at + 1] if at + 1 < len(values) else 0.0
    return float((sorted_[at] + max(0.0, below)) / 2), float(f1[at])


def held_out(key: str = "doc_id") -> Column:
    return fold(key, 4) == 2


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, score, predicted (1 from a score of ``CUT``)."""
    model = train(docs, labels, held_out(key), key, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    out = docs.select(
        key, held_out(key).alias("held_out"), F.pandas_udf(score, "double")(F.col(text)).alias("score")
    )
    return out.select(key, "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
