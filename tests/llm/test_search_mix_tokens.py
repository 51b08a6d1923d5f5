import random

import numpy as np
import pytest

from framewise.llm import mixing, sp_tokens, topk_threshold


def brute_top(rows, k):
    out = set()
    vectors = [(i, [int(np.floor(float(x) * 1024)) for x in v]) for i, v in rows]
    for q, v in vectors:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_top_k_equals_brute_force(spark, block):
    rnd = random.Random(block)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, rnd.uniform(-1, 1)]) for _ in range(6)]) for i in range(240)]
    rows += [(i, rows[3][1]) for i in range(300, 420)]  # a crowd of one vector: ties
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk_threshold.top_k(df, block_rows=block, block_queries=2).collect()
    assert {tuple(r) for r in got} == brute_top(exact, 10)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.5]), (6, []), (6, []),
        (None, [1.0, 1.0]), (100, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_threshold.top_k(df).collect())
    assert got == [
        (0, 1, 5, 1024 * 512), (0, 2, 6, 0), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 5, 0), (100, 3, 6, 0),
    ]
    assert topk_threshold.top_k(df.filter("vec_id > 900")).count() == 0


def test_walk_stops_early():
    rows = np.zeros((4000, 3), np.int64)
    rows[:, 0] = np.arange(4000)
    lists = topk_threshold.Lists(np.arange(4000), rows)
    ids, scores, depth = lists.top(np.array([5, 0, 0]), -1, 10)
    assert ids.tolist() == list(range(3999, 3989, -1)) and depth < 100
    big = topk_threshold.Lists(np.arange(2), np.array([[1 << 40], [3]]))
    assert big.top(np.array([1 << 20]), -1, 1)[1].tolist() == [1 << 60]


def test_targets_reshare_the_excess(spark):
    docs = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (100, "b"), (100, "c"), (3, None), (0, "d")])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    # weights a 3, b 1, c 2, d 3, NULL 1: a stops at 20, d at 0, NULL at 6; b and c share the rest
    total = 1.5 * 213
    assert got[0].target == 20 and got[4].target == 0 and got[3].target == 6
    assert got[1].target == pytest.approx((total - 26) / 3) and got[2].target == pytest.approx((total - 26) * 2 / 3)
    assert got[0].taken == 20 and got[3].taken == 6 and got[2].taken == int(got[2].target)


def test_every_source_comes_to_its_target(spark):
    rnd = random.Random(1)
    docs = [(i, "x y\n" * rnd.randint(0, 9), rnd.choice(["hot"] * 6 + ["b", "c", None]), "z") for i in range(6000)]
    docs += docs[:50] + [(None, None, None, "z")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string")
    mixed = mixing.mix(df).toPandas()
    assert len(mixed) == len(docs)
    assert (mixed.taken <= 2 * mixed["size"]).all()
    for _, g in mixed.groupby("source_size"):
        assert g.taken.sum() == int(g.target.iloc[0])
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken", "position"]
    assert mixed[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()


def test_positions_invert_the_demand(spark):
    knots = ((0.0, 4.5), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0))
    df = spark.createDataFrame([(i, "w", "s") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(df, schedules=(knots,), share=1.0, cap=1.0).toPandas()
    times = np.sort(got.position.values)
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
    area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    want = np.interp(np.arange(400) / 400, area / area[-1], grid)
    moving = (want < 0.249) | (want > 0.51)
    assert np.abs(times - want)[moving].max() < 1e-3
    assert times.min() >= 0 and times.max() <= 1


def test_repeated_rows_and_order(spark):
    rnd = random.Random(2)
    docs = [(i, " a  b\nc " * rnd.randint(1, 5), f"s{i % 3}", i) for i in range(300)] + [(7, "q w e", "s1", 0)] * 4
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, uses long")
    out = mixing.repeated(df)
    assert out.columns == df.columns
    rows = out.collect()
    size = sum(len(r.text.split()) for r in rows)
    assert abs(size - sum(m.taken for m in mixing.mix(df).collect())) <= 3
    assert mixing.repeated(df.filter("doc_id < 0")).count() == 0
    assert mixing.mix(df.filter("doc_id < 0")).count() == 0


TEXTS = [
    None, "", " ", "  two  blanks ", "Hello world", "line\nbreak\ttab", "日本語 текст ñandú 🙂 \u0000\u007f", "▁ marker", "<s> <0x41> </s>",
    "a" * 5000, "ab " * 30_000, "e\u0301 combining", "\u00a0nbsp\u2003em",
]


def test_tokens_equal_the_sentencepiece_library(spark):
    import sentencepiece

    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_fallback_x long")
    other = sentencepiece.SentencePieceProcessor(model_file=sp_tokens.MODEL_PATH)
    got = sp_tokens.encode_decode(df)
    back = {r.doc_id: r.text for r in sp_tokens.decode(got).collect()}
    for r in got.collect():
        text = TEXTS[r.doc_id]
        assert r.ids == other.encode(text or "")
        assert r.n_fallback == sum(other.is_byte(i) for i in r.ids)
        assert back[r.doc_id] == other.decode(r.ids)
        assert r.round_trip is (None if text is None else back[r.doc_id] == text)
        assert r.round_trip is not False or "▁" in text
    assert sp_tokens.encode_decode(df.limit(0)).count() == 0


def unigram_model():
    from sentencepiece import sentencepiece_model_pb2 as schema

    m = schema.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces = True, True
    m.normalizer_spec.remove_extra_whitespaces = True
    m.normalizer_spec.name = "identity"
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    pieces += [(p, -float(i + 1), 1) for i, p in enumerate(["▁", "ab", "a", "b", "▁ab", "ba", "abab", "c"])]
    for piece, score, kind in pieces:
        m.pieces.add(piece=piece, score=score, type=kind)
    return m.SerializeToString()


def test_unigram_model_is_rebuilt():
    model = unigram_model()
    sp_tokens.check_parity(sp_tokens.build(model), model, ["ab ab", "ababa  c", "xyz ab", " a b ", "ñ", "cabba"])


def test_slices_are_bounded():
    assert list(sp_tokens.slices(["aa", None, "bbb", "c" * 9, "d"], 5)) == [["aa", None, "bbb"], ["c" * 9], ["d"]]
