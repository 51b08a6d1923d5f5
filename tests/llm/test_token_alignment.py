import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewise.llm import sp_tokens, token_alignment

SF = "/root/testdata/sf0.001"


@lru_cache
def own():
    return token_alignment.Aligner(
        open(token_alignment.BYTE_BPE_PATH, "rb").read(), open(sp_tokens.MODEL_PATH, "rb").read()
    )


@lru_cache
def libraries():
    a = Tokenizer.from_file(token_alignment.BYTE_BPE_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=sp_tokens.MODEL_PATH)


def spelled(text):
    """(id, bytes) of the tokens of both, by the libraries themselves."""
    a, b = libraries()
    to_byte = token_alignment.byte_of_character()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    first = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return first, second


def groups_of(text):
    if not text:
        return []
    a, b = spelled(text)
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    out, i, j = [], 0, 0
    while i < len(a):
        left, right, n, m = [a[i][0]], [b[j][0]], len(a[i][1]), len(b[j][1])
        i, j = i + 1, j + 1
        while n != m:
            if n < m:
                left.append(a[i][0])
                n, i = n + len(a[i][1]), i + 1
            else:
                right.append(b[j][0])
                m, j = m + len(b[j][1]), j + 1
        out.append((left, right))
    return out


def brute(rows):
    found = [groups_of(t) for _, t in rows]
    links = [Counter((x, y) for left, right in g for x in left for y in right) for g in found]
    counts = Counter(p for one in links for p in one)
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (key, _), g, own_links in zip(rows, found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            key, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own_links.values()),
            sum(n for p, n in own_links.items() if counts[p] == best[p[0]]),
            sum(n * counts[p] for p, n in own_links.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "<|endoftext|> </s><s><unk>"), (6, "x ▁ y"), (7, "日本語 \U0001f469‍\U0001f680"),
    (8, "a\u0000b\t\n  c"), (9, "don't  stop 123456 <0x41>"), (9, "don't  stop 123456 <0x41>"), (None, "a"), (10, "word " * 3000),
    (11, "é́́ " * 50), (12, "aaaaaaaaaaaaaaa" * 40), (13, "\r\n" * 30), (14, "   x"),
]


@pytest.mark.parametrize("frequent", [0, 3, 1 << 20])
def test_odd_texts_equal_brute_force(spark, frequent):
    df = spark.createDataFrame([(k, t, 7, "x") for k, t in ODD], "doc_id long, text string, n_a int, digest string")
    got = token_alignment.aligned(df, frequent=frequent)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(ODD)
    assert token_alignment.aligned(df.limit(0)).collect() == []


@pytest.mark.parametrize("frequent", [500, 1 << 20])
def test_table_equals_brute_force(spark, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = token_alignment.aligned(docs, frequent=frequent)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_ids_equal_the_tokenizers_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, _ = libraries()
    for r in docs.filter(F.col("text").isNotNull()).select("text").collect():
        assert own().a.encode(" " + r.text) == a.encode(" " + r.text, add_special_tokens=False).ids


def test_long_runs(spark):
    for text in (" " * 200_000, "a" * 200_000, "\n" * 100_000, "漢" * 50_000):
        (n_a, n_b, n_groups, n_links, _), codes, links = own().align(text)
        assert n_a and n_b and n_groups and links.sum() == n_links and len(codes) == len(set(codes.tolist()))


def test_groups_with_many_links_are_counted_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 9, 300)
    in_a, in_b = np.array([1, 250, 149]), np.array([2, 200, 98])
    whole = own().pairs(a, b, in_a, in_b)
    monkeypatch.setattr(token_alignment, "MOST_LINKS", 500)
    for x, y in zip(whole, own().pairs(a, b, in_a, in_b)):
        assert (x == y).all()
    want = Counter()
    for g in range(3):
        for x in a[in_a[:g].sum() : in_a[: g + 1].sum()]:
            for y in b[in_b[:g].sum() : in_b[: g + 1].sum()]:
                want[int(x) * len(own().sizes_b) + int(y)] += 1
    assert dict(zip(whole[0].tolist(), whole[1].tolist())) == want
