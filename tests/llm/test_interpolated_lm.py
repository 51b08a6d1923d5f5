import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import interpolated_lm as lm

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*lm.words_of(text), lm.END]


def deleted(spark, keys):
    rows = spark.createDataFrame([(str(k) if k is not None else None,) for k in keys], "k string")
    tenth = F.pmod(F.xxhash64("k", F.lit("deleted")), F.lit(lm.DELETED_PARTS)) == 0
    return [r.t for r in rows.select(tenth.alias("t")).collect()]


def bucket(n):
    return 0 if n == 0 else 1 + int(math.log2(n))


def counts(texts):
    one, two = Counter(), Counter()
    for text in texts:
        before = lm.BEGIN
        for t in tokens(text):
            one[t] += 1
            two[before, t] += 1
            before = t
    return one, two


def brute(spark, rows, rounds=lm.ROUNDS):
    """Deleted interpolation by the book, with dictionaries."""
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    gone = deleted(spark, [k for k, _ in rows])
    kept = [t for (_, t), h, d in zip(rows, held, gone) if not h and not d]
    cut = [t for (_, t), h, d in zip(rows, held, gone) if not h and d]
    one, two = counts(kept)
    total, kinds = sum(one.values()), len(one)
    heads = len(kept)
    weights = {b: (0.1, 0.4, 0.5) for b in range(lm.BUCKETS)}
    events, seen, before = counts(cut)[1], set(), -math.inf
    for _ in range(rounds):
        sums, likely = {}, 0.0
        for (u, w), n in events.items():
            c = heads if u == lm.BEGIN else one[u]
            part = [1 / (kinds + 1), one[w] / max(total, 1), two[u, w] / max(c, 1)]
            mix = [a * b for a, b in zip(weights[bucket(c)], part)]
            likely += n * math.log(sum(mix))
            s = sums.setdefault(bucket(c), [1.0, 1.0, 1.0])
            for i in range(3):
                s[i] += n * mix[i] / sum(mix)
        for b, s in sums.items():
            weights[b] = tuple(x / sum(s) for x in s)
            seen.add(b)
        n = sum(events.values())
        if not n or likely - before < lm.TOLERANCE * n:
            break
        before = likely
    if seen:
        weights = {b: weights[min(sorted(seen), key=lambda k: abs(k - b))] for b in weights}
    one, two = counts([t for (_, t), h in zip(rows, held) if not h])
    total, kinds, heads = sum(one.values()), len(one), held.count(False)
    out = []
    for (key, text), h in zip(rows, held):
        before, base, score = lm.BEGIN, 0.0, 0.0
        for t in tokens(text):
            c = heads if before == lm.BEGIN else one[before]
            part = [1 / (kinds + 1), one[t] / max(total, 1), two[before, t] / max(c, 1)]
            score += math.log10(sum(a * b for a, b in zip(weights[bucket(c)], part)))
            base += math.log10((one[t] + 1) / (total + kinds + 1))
            before = t
        known = sum(one[t] > 0 for t in tokens(text))
        out.append((key, h, len(tokens(text)), known, total, base, score))
    return sorted(out, key=lambda r: (r[0] is None, r[0], r[2], r[5]))


def same(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: (r[0] is None, r[0], r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_equals_the_model_by_dictionaries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = lm.scored(docs, chunk_chars=1 << 16, range_chars=1 << 16).collect()
    same(got, brute(spark, rows))


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, "A b a\tB c"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (None, "x y x"), (None, "x y x")]
    rows += [(i, f"a b c{i % 3} Ä d") for i in range(10, 80)] + [(90, "w " * 3000 + "İ end")]
    df = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id long, text string, chunk string, _part int")
    same(lm.scored(df, chunk_chars=50, range_chars=50).collect(), brute(spark, rows))


def test_empty_table_and_no_training_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scored(empty).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (row,) = lm.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)


def test_probabilities_of_a_context_add_up_to_one():
    chunk = lm.Chunk(["a b a c", "b a"])
    words, pairs = chunk.split(chunk.counts)
    weights = np.array([0.2, 0.3, 0.5])
    total = words.sum() - 2  # the begin is no token
    kinds = chunk.names - 1
    for u in range(chunk.names):
        own = chunk.u == u
        if not own.any():
            continue
        p2, _ = lm.terms(words[chunk.u], words[chunk.w], pairs, total)
        p1 = np.delete(words, 0) / total
        assert sum(p2[own]) == pytest.approx(1)
        mixed = weights[0] * (kinds + 1) / (kinds + 1) + weights[1] * p1.sum() + weights[2] * p2[own].sum()
        assert mixed == pytest.approx(1)


def test_beats_the_unigram_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.scored(docs).filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.3


def test_keys_survive_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    for some in (keys, keys >> np.uint64(20), keys[:1] * np.uint64(0)):
        assert (lm.unpacked(lm.packed(some)) == some).all()
