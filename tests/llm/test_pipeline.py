import random

import corpus_pipeline as pipeline

from framewise.llm import line_templates, mixing, nbsvm, sp_tokens

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(texts):
    """Smallest id of each component of texts linked at a Jaccard similarity of 0.8, by brute force."""
    sets, top = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a_root, b_root = root(a), root(b)
                top[max(a_root, b_root)] = min(a_root, b_root)
    return sorted(k for k in keys if root(k) == k)


def test_each_stage_follows_its_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
        if name != "tokens":
            assert docs.columns == columns
    before, after = kept["quality"]
    good = {r.doc_id for r in nbsvm.scored(before, labels).collect() if r.predicted == 1}
    assert {r.doc_id for r in after.collect()} == good
    before, after = kept["lines"]
    rows = line_templates.deduplicated(before, min_tokens=1).collect()
    cut = {(r.doc_id, r.text) for r in rows if r.n_dropped == 0 or r.text.split()}
    assert {(r.doc_id, r.text) for r in after.collect()} == cut
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["near_duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == survivors({r.doc_id: r.text for r in before.collect()})
    before, after = kept["mix"]
    words = sum(len(r.text.split()) for r in after.collect())
    assert abs(words - sum(r.taken for r in mixing.mix(before).collect())) <= 20
    before, after = kept["tokens"]
    texts = sorted(r.text for r in before.collect())
    assert sorted(r.text for r in sp_tokens.decode(after).collect()) == texts


def test_lines_stage_keeps_a_holder_of_every_template(spark):
    shared = "\n".join(f"shared passage {chr(97 + i)} of several words here" for i in range(20))
    first = "this line is held by the second document first"
    docs = [(1, shared), (2, shared + "\n" + first), (3, first + "\nwords of the third document only"), (4, shared)]
    df = spark.createDataFrame([(k, "en", "s", t, len(t)) for k, t in docs], "doc_id long, lang string, source string, text string, n_chars long")
    out = {r.doc_id: r.text for r in pipeline.lines(spark, df, "").collect()}
    assert sorted(out) == [1, 2, 3] and out[2] == first
    kept = {line for text in out.values() for line in text.split("\n")}
    assert kept == {line for _, text in docs for line in text.split("\n")}


def test_near_duplicates_stage_finds_scattered_edits(spark):
    rnd = random.Random(8)
    docs = []
    for i in range(60):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        docs.append((2 * i, " ".join(words)))
        for at in rnd.sample(range(5, 295), 5):
            words[at] = f"e{rnd.randrange(10**6)}"
        docs.append((2 * i + 1, " ".join(words)))

    want = set()
    for (a, x), (b, y) in zip(docs[::2], docs[1::2], strict=True):
        x, y = shingles(x), shingles(y)
        want |= {a} if len(x & y) >= 0.8 * len(x | y) else {a, b}
    assert 60 <= len(want) < 75
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()} == want


def test_near_duplicates_stage_keeps_all_links_of_a_crowd(spark):
    """Pairs at 0.84 that all share one long passage, other pairs just below 0.8."""
    rnd = random.Random(3)
    passage = [f"p{rnd.randrange(10**6)}" for _ in range(270)]
    docs = []
    for i in range(150):
        own = [f"w{rnd.randrange(10**7)}" for _ in range(36)]
        docs.append((2 * i, " ".join(passage + own)))
        at = rnd.sample(range(30, 240, 12), 5)
        words = list(passage)
        for j in at:
            words[j] = f"e{rnd.randrange(10**7)}"
        docs.append((2 * i + 1, " ".join(words + own)))
    sets = {k: shingles(t) for k, t in docs}
    cross = [len(sets[0] & sets[k]) / len(sets[0] | sets[k]) for k in range(2, 300)]
    pair = [len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(150)]
    assert max(cross) < 0.8 <= min(pair)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()) == survivors(dict(docs))


def test_run_and_nulls(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", None, None, 0)], docs.schema)
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_fallback", "round_trip", "n_tokens"]
    assert out.filter("round_trip = false").count() == 0 and out.count() > 20
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(str(empty / "labels.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0
