import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from framewise.llm import crf, html_blocks, html_extract, labelled, nbsvm, toxicity

DATA = "/root/testdata/sf0.01"


def brute_chain(scores, moves, first):
    """Sums over all labelings."""
    total, ones, best = 0.0, np.zeros(len(scores)), (-1e300, None)
    for y in itertools.product((0, 1), repeat=len(scores)):
        s = first * y[0] + sum(v for v, l in zip(scores, y, strict=True) if l)
        s += sum(moves[a][b] for a, b in zip(y, y[1:], strict=False))
        total += np.exp(s)
        ones += np.exp(s) * np.array(y)
        best = max(best, (s, y))
    return np.log(total), ones / total, list(best[1])


def test_marginals_and_viterbi_equal_enumeration():
    rnd = np.random.default_rng(0)
    moves, first = rnd.normal(size=(2, 2)), 0.3
    lengths = [1, 5, 7]
    emit, mask = np.zeros((3, 7)), np.zeros((3, 7), bool)
    for i, n in enumerate(lengths):
        emit[i, :n], mask[i, :n] = rnd.normal(size=n), True
    with_first = emit.copy()
    with_first[:, 0] += first
    log_z, one, expected = crf._marginals(with_first, mask, moves)
    want = [brute_chain(emit[i, :n].tolist(), moves.tolist(), first) for i, n in enumerate(lengths)]
    assert np.isclose(log_z, sum(w[0] for w in want))
    assert np.isclose(expected.sum(), sum(n - 1 for n in lengths))
    chain = crf.Chain({}, tuple(map(tuple, moves.tolist())), first)
    for i, n in enumerate(lengths):
        assert np.allclose(one[i, :n], want[i][1])
        assert chain.decode(emit[i, :n].tolist()) == want[i][2]
    assert chain.decode([]) == []


def test_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><body class='Page-wrap'><p>a<b>b</b> c<p>d &amp; e&nbsp;f"
        "<script>var x='</p>';</script><ul><li>one<li>two <a href=x>link</a></ul><!-- no --><div>x<br>y</div>tail<textarea>q<b></textarea>"
    )
    got = html_blocks.blocks(page)
    assert [b.text for b in got] == ["ab c", "d & e f", "one", "two link", "x", "y", "tail", "q<b>"]
    first = got[0].around
    assert (first.own, first.parent) == ("p", "body")
    assert (first.tags, first.names, first.inner) == ({"html", "body", "p"}, {"page", "wrap"}, None)
    assert (got[3].around.own, got[3].around.parent, got[3].linked) == ("li", "ul", 4)
    for text in ("", "<", "<p", "<a href='x", "<!--", "<script>x", "</", "<p>&am", "<div>" * 50_000, "<" * 50_000, "<a " + "b='" * 9999):
        assert isinstance(html_blocks.blocks(text), list)
    deep = html_blocks.blocks("<div>" * 5000 + "x")
    assert deep[0].around == html_blocks.NOTHING.within("div", frozenset()).within("div", frozenset())
    many = "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{i}><p>t" for i in range(20_000))
    assert len(html_blocks.blocks(many, frozenset(["cabx"]))) == 20_000
    page = "<main class=a>x<article id=b>y<aside class=c>z</aside></article>t</main>u"
    inner = [(b.around.inner, b.around.inner_names) for b in html_blocks.blocks(page)]
    at = [({"main"}, {"a"}), ({"article"}, {"b"}), ({"article", "aside"}, {"b", "c"}), ({"main"}, {"a"}), (None, None)]
    assert inner == at


def test_deep_parts_and_long_pages():
    long = "<nav><ul>" + "<li><a href=/>Go on</a>" * 900 + "</ul></nav><article><p>Text, and more.</article><footer>&copy; end</footer>"
    pages, labels = html_extract.labelled_pages([long])
    tail = [y for p, y in zip(pages[html_extract.COMPOSED :], labels[html_extract.COMPOSED :], strict=True)]
    assert [len(y) for y in tail] == [html_extract.CHAIN, 902 - html_extract.CHAIN] and tail[1][-2:] == [1, 0]
    chain = crf.train(pages, labels)
    assert html_extract.extract(long, chain) == "Text, and more."
    chain = crf.train(*html_extract.labelled_pages([]))
    down, up = "<div>" * 60, "</div>" * 60
    boiler = f"<aside>{down}<p>Deep aside, with a text. And more.</p>{up}</aside>"
    article = f"<article>{down}<p>Deep text, as it is. And more.</p>{up}</article>"
    assert html_extract.extract(f"<body>{'<div>' * 42}{boiler}", chain) == ""
    assert html_extract.extract(f"<body>{'<div>' * 42}{boiler}{article}{boiler}", chain) == "Deep text, as it is. And more."


def test_chains_of_any_length_train_together():
    rnd = np.random.default_rng(4)
    pages, labels = [], []
    for n in (1, 2, 3, 40, 200, 0):
        y = (rnd.random(n) < 0.5).astype(int).tolist()
        pages.append([["bias", f"f{v}"] for v in y])
        labels.append(y)
    chain = crf.train(pages, labels)
    for p, y in zip(pages, labels, strict=True):
        assert chain.decode([sum(chain.weights[f] for f in fs) for fs in p]) == y
    assert crf.train([], []).weights == {}


def test_extraction_on_pages_not_seen_in_training():
    chain = crf.train(*html_extract.labelled_pages([]))
    composer, wrong = html_extract.Composer(1234), 0
    for _ in range(200):
        html = composer.page()
        page = html_blocks.blocks(html)
        want = " ".join(b.text for b, y in zip(page, html_extract.gold_labels(page), strict=True) if y)
        wrong += html_extract.extract(html, chain) != want
    assert wrong <= 10


def test_main_text(spark):
    article = "<h1>Head</h1><p>First &amp; second.<p>Third\n  one. And more, of course."
    around = "<nav><ul><li><a href=/>Home</a></ul></nav>{}<footer>&copy; me. All rights, reserved.</footer>"
    htmls = [
        None, "", f"<body>{around.format(f'<article>{article}</article>')}",
        "<body>" + around.format(f"<main>{article}<aside class=sidebar><p>Read this, too. Now.</p></aside></main>"),
        "<body><div class=comments><p>Nice text, I think. Yes.</p></div>", f"<article>{article}<p>cut &am",
    ]
    data = [(i, f"u{i}", h, "x") for i, h in enumerate(htmls)]
    df = spark.createDataFrame([*data, data[2]], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.main_text(df).collect())
    want = "Head First & second. Third one. And more, of course."
    texts = ["", "", want, want, want, "", want + " cut &am"]
    assert [g[2] for g in got] == texts
    assert [g[3] for g in got] == [len(t) for t in texts]
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_pages_of_the_table_keep_their_article(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.main_text(pages).collect():
        page = html_blocks.blocks(html[r.page_id])
        assert r.text == " ".join(b.text for b in page if "article" in b.around.tags)


def test_folds_and_samples(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(None, "n")], "doc_id long, text string")
    got = df.select("doc_id", labelled.fold("doc_id", 3).alias("f")).collect()
    assert all(r.f == (0 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3) for r in got)
    marks = [(i, i % 2, None) for i in range(80)] + [(1, 0, None), (5, None, None), (None, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    some = labelled.sampled(df, labels, "quality", nbsvm.held_out(), {0: 7, 1: 9})
    rows = some.collect()
    assert sorted(r._label for r in rows) == [0] * 7 + [1] * 9
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r._label == r.doc_id % 2 for r in rows)


def test_dual_descent_reaches_the_optimum():
    rnd = np.random.default_rng(1)
    rows = [np.sort(rnd.choice(40, 8, replace=False)) for _ in range(60)]
    labels = np.array([int(r.sum() > 156) for r in rows])
    model = nbsvm.fit(rows, labels, c=1.0, rounds=2000)
    ratio = nbsvm.log_ratios(rows, labels, nbsvm.SLOTS + nbsvm.KIND_GRAMS)
    known = np.flatnonzero(ratio[:40] != 0)
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(len(r))
    x[:, 40] = 1.0
    sign = np.where(labels == 1, 1.0, -1.0)

    def loss(w):
        return w @ w / 2 + np.maximum(0, 1 - sign * (x @ w)).sum()

    w = np.zeros(41)
    w[known] = model.weights[known] / ratio[known]
    w[40] = model.bias
    best = loss(w)
    assert all(loss(w + rnd.normal(scale=0.01, size=41)) >= best - 1e-3 for _ in range(300))


def test_features():
    assert len(nbsvm.features(None)) == len(nbsvm.features(" \n")) == 0
    one = set(nbsvm.features("ab ab").tolist())
    assert nbsvm.SLOTS + 3 in one  # a word like the one before
    assert set(nbsvm.features("ab").tolist()) - {nbsvm.SLOTS} <= one
    long = "xyz " * 600_000
    assert set(nbsvm.features(long).tolist()) >= set(nbsvm.features("xyz xyz xyz xyz").tolist())
    flags = np.zeros(nbsvm.SLOTS, bool)
    assert (nbsvm.features("some text", flags) == nbsvm.features("some text")).all() and not flags.any()


def quality_rows(n=400):
    rnd = random.Random(5)
    plain = lambda: " ".join("".join(rnd.choices("etaoin", k=rnd.randint(2, 8))) for _ in range(40)) + "."
    junk = [lambda: plain().upper().replace(" ", "!! "), lambda: plain().replace(" ", " | "), lambda: " ".join(["buy now"] * 30)]
    return [(i, plain() if i % 2 else rnd.choice(junk)(), i % 2) for i in range(n)]


def test_quality_on_held_out_rows(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(9000, None, "s"), (9001, "", "s"), (0, rows[0][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = nbsvm.scored(df, labels).collect()
    assert len(got) == 403
    truth = dict((i, q) for i, _, q in rows)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    again = {(r.doc_id, r.score) for r in nbsvm.scored(df.repartition(5), labels.repartition(3)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}
    assert nbsvm.accepted(df, labels).columns == df.columns
    assert nbsvm.scored(df.limit(0), labels).count() == 0
    none = nbsvm.scored(df, labels.limit(0)).collect()
    assert all(r.score == 0.5 for r in none)


def toxic_rows(n=600):
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choices("aeioustnr", k=rnd.randint(2, 9))) for _ in range(rnd.randint(3, 90))]
        if i % 4 == 0:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["vilefool", "dregwight", "gloomhex"]) + rnd.choice(["", ",", "s"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(9000, None, "s"), (9001, " ", "s")], "doc_id long, text string, segment string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, toxic int")
    got = toxicity.scored(df, labels).collect()
    truth = dict((i, q) for i, _, q in rows)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in got if r.doc_id >= 9000} == {0.0}
    assert toxicity.scored(df.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.scored(df, labels.limit(0)).collect()} == {0.0}


def test_toxicity_reads_words_without_blanks_to_their_end(spark):
    rows = toxic_rows()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.lit(False))
    toxic = max((t for _, t, q in rows if q == 1), key=model.score)
    marker = max(toxic.split(), key=model.score)
    assert model.score(marker) >= toxicity.CUT
    filler = "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(35_000))
    assert len(filler.encode()) > 100_000 and model.score(filler) < toxicity.CUT
    for size in (50, 300, 1000, 35_000):
        assert model.score(filler[:size] + f" {marker}" * 3) >= toxicity.CUT
    # a window keeps its end: six words, the last of them the marker
    long = " ".join([filler[i : i + 200] for i in range(0, 1000, 200)] + [marker])
    assert max(model.gains(long)) >= model.window_cut
    for n in (0, 1, 192, 193, 377, 378, 5000):
        window = bytes(random.Random(n).randrange(256) for _ in range(n))
        parts = list(toxicity.pieces(window))
        assert max(map(len, parts)) <= toxicity.MOST_BYTES
        assert all(any(window[i : i + 8] in p for p in parts) for i in range(n - 7))


def test_toxicity_recall_of_each_language(spark):
    # languages whose markers stand in ordinary texts too, where only their share tells
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels).filter("held_out").collect()}
    truth = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hits, false, ordinary = {}, 0, 0
    for r in docs.select("doc_id", "lang").join(truth, "doc_id").collect():
        if r.doc_id in got and r.toxic == 1:
            hits.setdefault(r.lang, []).append(got[r.doc_id])
        elif r.doc_id in got:
            false, ordinary = false + got[r.doc_id], ordinary + 1
    assert set(hits) == {"de", "en", "es", "fr"}
    assert all(sum(h) >= 0.7 * len(h) for h in hits.values()), {k: (sum(h), len(h)) for k, h in hits.items()}
    assert false <= 0.01 * ordinary, (false, ordinary)


def test_cover_prefers_what_is_not_yet_covered():
    owners = [[0, 1], [0, 1], [0, 1], [2], [2]]
    assert toxicity.cover(owners, 3, times=1) == [0, 2]
    assert toxicity.cover(owners, 3, times=2) == [0, 1, 2]


def test_best_cut():
    assert toxicity.best_cut(np.array([0.0, 0.1, 0.5, 0.9]), np.array([0, 0, 1, 1])) == (0.3, 1.0)
    assert toxicity.best_cut(np.zeros(3), np.array([0, 1, 1])) == (1.0, 0.0)
    # a heavy ordinary text is left out at the price of a toxic one
    values, labels = np.array([0.9, 0.5, 0.4]), np.array([1, 0, 1])
    assert toxicity.best_cut(values, labels)[0] == 0.2
    assert toxicity.best_cut(values, labels, 9.0)[0] == 0.7


def test_toxicity_learns_from_every_labelled_text(spark):
    # the marker stands in texts that a sample of the smallest hashes would leave out
    n = 2600
    ids = spark.range(2 * n).filter("id % 2 = 1")
    last = {r.id for r in ids.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)).desc()).limit(80).collect()}
    rnd = random.Random(4)
    rows = []
    for i in range(2 * n):
        words = ["".join(rnd.choices("aeioustnr", k=5)) for _ in range(6)]
        marker = "gloomhex" if i in last else "vilefool"
        rows.append((i, " ".join([*words, marker] if i % 2 else words), i % 2))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.lit(False))
    assert all(model.score(t) >= toxicity.CUT for i, t, _ in rows if i in last)
    assert sum(model.score(t) >= toxicity.CUT for _, t, q in rows if q == 0) < 0.01 * n


def test_cover_of_a_table_chooses_as_in_memory(spark, monkeypatch):
    rnd = random.Random(8)
    owners = [sorted(rnd.sample(range(30), rnd.choice([0, 1, 2, 5, 9]))) for _ in range(300)]
    df = spark.createDataFrame([(o,) for o in owners], "s array<int>").repartition(3)
    for block, kinds, most in ((64, 200_000, 256), (4, 200_000, 256), (16, 40, 7)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "MOST_KINDS", kinds)
        assert toxicity.cover_texts(df, most=most) == toxicity.cover(owners, 30, most=most)
    assert toxicity.cover_texts(df.limit(0)) == []


def test_best_cut_of_a_table(spark):
    rnd = random.Random(3)
    rows = [(int(rnd.random() < 0.3), cut, rnd.randrange(40) / 8) for cut in (1, 2, 3) for _ in range(200)]
    rows = [(label, cut, rate * (1 + label) if cut > 1 else rate) for label, cut, rate in rows]
    for cut in (1, 2, 3):
        own = [r for r in rows if r[1] == cut]
        labels, values = np.array([r[0] for r in own]), np.array([r[2] for r in own])
        df = spark.createDataFrame(own, "label int, cut int, rate double")
        expected = (cut, toxicity.best_cut(values, labels)[0])
        assert toxicity.best_cut_of_table(df, int(labels.sum())) == expected
    # equal curves: the smaller cut
    twice = df.unionAll(df.withColumn("cut", F.lit(2)))
    assert toxicity.best_cut_of_table(twice, int(labels.sum())) == (2, expected[1])
    assert toxicity.best_cut_of_table(df.limit(0), 5) == (1, 1.0)


def test_segments_count_words_not_runs():
    found, times = toxicity.segments("aaaaaaa aaaaaaa  xyz\tbé a")
    names = [int(n).to_bytes(5, "big") for n in found]
    assert dict(zip(names, times.tolist(), strict=True)) == {b" aaaa": 2, b"aaaaa": 2}
    assert [len(x) for x in toxicity.segments(None)] == [0, 0]


def test_buckets_keep_every_frequent_segment(spark):
    rnd = random.Random(11)
    rows = [(int(i % 9 == 0), " ".join("".join(rnd.choices("abc", k=12)) for _ in range(20))) for i in range(200)]
    rows += [(1, "gloomhexes " * 3)] * 9
    df = spark.createDataFrame(rows, "_label int, text string").repartition(3)
    words = {c: sum(len(t.split()) for x, t in rows if x == c) for c in (0, 1)}
    least = {c: toxicity._least(words, c) for c in (0, 1)}
    buckets = toxicity.frequent_buckets(df, "text", least)
    assert 0 < buckets.sum() < 1000
    whole, kept = (toxicity.segment_counts(df, "text", toxicity.LONG_SEGMENT, b) for b in (None, buckets))
    assert kept.count() < 0.2 * whole.count()
    for c in (0, 1):
        found = [sorted(map(tuple, t.filter(toxicity._frequent(words, c)).collect())) for t in (whole, kept)]
        assert found[0] == found[1]
        assert len(found[0]) > 0 or c == 0
