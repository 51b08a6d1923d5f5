import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framewise.llm import line_templates, near_copies, queries, simhash_anchors


def brute_fingerprint(text):
    words = [w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [
    None, "", " \t", "One", "one", "ÀB cd", "a b c", "a b c a b c", "A\x0bB\x0cC\x1cD e", "x " * 20_000,
    "İ K ſ words stay",
]


def test_fingerprints_equal_brute_force(spark):
    for t in TEXTS:
        assert simhash_anchors.fingerprint_of(t) % 2**64 == brute_fingerprint(t), t
    # the hash is the engine's own
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def brute_components(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_join_the_same_components(spark, crowd):
    rnd = random.Random(crowd)
    values = set()
    for _ in range(12):
        v = rnd.getrandbits(64)
        values.add(v)
        for _ in range(25):  # chains and crowds around it
            w = v
            for _ in range(rnd.randint(1, 3)):
                w ^= 1 << rnd.randrange(64)
            values.add(w)
            v = rnd.choice([v, v, w])
    signed = [int(np.uint64(v).astype(np.int64)) for v in sorted(values)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash_anchors.links(df, crowd=crowd).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    want = brute_components(sorted(values))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {v: find(v) for v in values} == want


def test_components_of_documents(spark):
    words = [f"w{i}" for i in range(400)]
    near = [" ".join(words[:399] + [f"end{i}"]) for i in range(8)]
    texts = [*TEXTS, *near, "completely different text here", near[0].upper(), *["one more copy"] * 5]
    data = [(i + 10, t, "x", i) for i, t in enumerate(texts)] + [(None, "one", "x", 0), (13, "One", "x", 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, component_id string, fp long")
    got = simhash_anchors.near_duplicates(df).collect()
    assert len(got) == len(data)
    prints = {}
    for r in got:
        prints.setdefault(int(r.fingerprint, 16), []).append(r.doc_id)
    root = brute_components(sorted(prints))
    least = {}
    for v, ids in prints.items():
        known = [i for i in ids if i is not None]
        if known:
            least[root[v]] = min([least.get(root[v], 10**9), *known])
    assert all(r.component_id == least[root[int(r.fingerprint, 16)]] for r in got)
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash_anchors.near_duplicates(df.limit(0)).count() == 0
    assert near_copies.keep_one(df.limit(0)).count() == 0


def brute_kept(texts):
    """The smallest place of every component of sets with a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        words = t.split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(texts))}


def test_crowds_without_common_rare_shingles(spark):
    rnd = random.Random(2)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for at in [*range(10, 22)] * 9 + [*range(27, 34)] * 14 + [*range(45, 47)] * 40 + [60] * 3:
        words = list(base)
        words[at] = f"own{len(texts)}"  # one word each: what is rare about a text is in no other
        texts.append(" ".join(words))
    for _ in range(40):  # other lengths around the same words
        start = rnd.randint(0, 30)
        texts.append(" ".join(base[start : start + rnd.randint(20, 50)] + [f"end{len(texts)}"]))
    texts += ["", "b0 b1", " ".join(base)]
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == brute_kept(texts)


def test_texts_without_a_common_band_are_compared(spark):
    """One pair in some thousands of similarity 0.8 shares none of the bands, and both texts stayed before."""
    rnd = random.Random(1)
    words = [[str(rnd.randrange(10**6)) for _ in range(49)] for _ in range(3970)][-1]
    texts = [" ".join(words), " ".join([*words[:20], "x", *words[21:]]), "another text altogether"]
    assert not set(near_copies.sketch_of(texts[0])[1]) & set(near_copies.sketch_of(texts[1])[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == sorted(brute_kept(texts)) == [0, 2]


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_shared_shingles_alone_find_all_links(spark, monkeypatch, crowd):
    none = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "band long, set long")
    monkeypatch.setattr(near_copies, "candidates", lambda classes: none)  # no band shows anything
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rnd = random.Random(4)
    passage, texts = [f"p{i}" for i in range(30)], []
    for _ in range(25):
        base = [f"b{rnd.randrange(10**6)}" for _ in range(rnd.choice([3, 8, 20, 60]))]
        base = base + passage if rnd.random() < 0.5 else base
        for _ in range(rnd.choice([1, 2, 5])):
            own = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                own[rnd.randrange(len(own))] = f"own{len(texts)}"
            texts.append(" ".join(own))
    texts += ["", " ", texts[3]]
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_kept(texts)
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == want and len(want) < len(set(texts)) - 5


def test_crowd_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 200)  # several blocks of every class
    rnd = random.Random(5)
    data = []
    for i in range(400):
        own = set(rnd.sample(range(40 if i % 2 else 4000), rnd.choice([0, 1, 4, 5, 20, 25, 30])))
        data.append((i, sorted(own)))
    for i in range(400, 440):
        near = set(data[i - 300][1])
        data.append((i, sorted(near | {5000 + i} if len(near) > 4 else near)))
    sets = spark.createDataFrame(data, "set long, own array<long>")
    crowds = spark.createDataFrame([(i % 2, i) for i, _ in data] + [(7, i) for i in range(90, 130)], "band long, set long")
    found = spark.createDataFrame([(i, i // 10) for i in range(0, 300)], "set long, _c long")
    got = [(r.a, r.b) for r in near_copies.crowd_links(crowds, sets, found).collect()]
    own = {i: set(v) for i, v in data}
    label = {i: i // 10 if i < 300 else i for i, _ in data}

    def close(a, b):
        return 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])

    def merged(pairs):
        parent = {c: c for c in label.values()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(label[a]), find(label[b])
            parent[max(a, b)] = min(a, b)
        return {i: find(c) for i, c in label.items()}

    assert all(close(a, b) and label[a] != label[b] for a, b in got)
    together = [(a, b) for a in own for b in range(a) if (a % 2 == b % 2) or (90 <= a < 130 and 90 <= b < 130)]
    assert merged(got) == merged([p for p in together if close(*p)])


def brute_lines(docs, similar=0.8, depth=4, least=3):
    """The same rules as plain loops over all lines."""
    parsed = []
    for key, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            tokens = ["<*>" if any(c.isdigit() and c.isascii() for c in t) else t for t in line.split()]
            if len(tokens) >= least:
                parsed.append((key, text, at, tuple(tokens)))
    holders = {}
    for key, text, _, tokens in parsed:
        holders.setdefault(tokens, set()).add((key, text))
    leaves = {}
    for tokens in holders:
        leaves.setdefault((1, len(tokens), tokens[:depth]), []).append(tokens)
        if len(tokens) > 2 * depth:
            leaves.setdefault((2, len(tokens), tokens[depth : 2 * depth]), []).append(tokens)
    templates = {t: {("line", t)} for t in holders}
    for leaf, lines in leaves.items():
        if len(lines) < 2:
            continue
        shape = []
        for j in range(leaf[1]):
            counts = {}
            for t in lines:
                counts[t[j]] = counts.get(t[j], 0) + len(holders[t])
            shape.append(max(counts, key=lambda x: (counts[x], x.encode())))
        for t in lines:
            if sum(a == b for a, b in zip(t, shape, strict=True)) >= similar * len(t):
                templates[t].add(leaf)
    users = {}
    for key, text, _, tokens in parsed:
        for template in templates[tokens]:
            users.setdefault(template, set()).add((key, text))
    drop = {}
    for key, text, at, tokens in parsed:
        if any((key, text) != min(users[template]) for template in templates[tokens]):
            drop.setdefault((key, text), set()).add(at)
    return {
        (key, text): "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in drop.get((key, text), ()))
        for key, text in docs
    }


def test_lines_equal_brute_force(spark):
    rnd = random.Random(3)
    words = "the of and to in a is that for it".split()
    docs = []
    for i in range(60):
        lines = [" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 4))]
        if i % 3 == 0:
            lines.append(f"Posted on day {rnd.randint(1, 99)} by user{rnd.randint(1, 9)} in the forum")
        if i % 4 == 0:
            long = "this passage of many words is the same in several documents but for a word".split()
            long[rnd.randint(0, 14)] = rnd.choice(words)
            lines.append(" ".join(long))
        docs.append((i, "\n".join(lines)))
    docs += [(100, ""), (101, "a b c d\n\n a b c d"), (102, "lonely words only here"), (103, docs[5][1])]
    docs += [(104, "these lines stand twice\nboth of them do"), (105, "these lines stand twice\nboth of them do")]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, _at string")
    got = {r.doc_id: r for r in line_templates.deduplicated(df).collect()}
    want = brute_lines(docs)
    for key, text in docs:
        assert got[key].text == want[key, text], key
        assert got[key].n_lines == len(text.split("\n"))
    cut = line_templates.without_recurring_lines(df, min_left=0.2)
    assert cut.columns == df.columns
    ids = {r.doc_id for r in cut.collect()}
    assert {100, 101, 102, 104} <= ids and 105 not in ids


def test_lines_with_nulls(spark):
    docs = [(None, "shared line of five\nown words stay here"), (1, "shared line of five"), (2, None), (1, "shared line of five")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text, r.n_dropped) for r in line_templates.deduplicated(df).collect())
    assert [g[1:] for g in got] == [("shared line of five", 0)] * 2 + [(None, 0), ("own words stay here", 1)]
    assert line_templates.deduplicated(df.limit(0)).count() == 0


def test_short_lines_recur_as_a_whole(spark, tmp_path):
    passage = "这是一个没有空格的段落因此整行只是一个词" * 3
    docs = [(1, f"Les.\n{passage}\n\nown words of one"), (2, f"Les.\n{passage}2024\n\nAnd ornd."), (3, f"{passage}\n\nAnd ornd.\n7"), (4, "8\n "), (5, "8\nLes. 1")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in queries.QUERIES["op6_line_templates"](spark, str(tmp_path)).collect()}
    assert got == {
        1: docs[0][1], 2: f"{passage}2024\n\nAnd ornd.", 3: "\n7", 4: "8\n ", 5: "Les. 1",
    }
