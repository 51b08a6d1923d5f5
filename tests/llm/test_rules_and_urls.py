import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from framewise.llm import link_trust, quality_rules
from framewise.llm.queries import OP1_SQL

TEXTS = [
    None, "", " \n\t ", "one", "a a a a a a a a a a a", " x\nx\n \nx ", "a|b #c $d & <e> *f* 100%",
    " ".join(f"w{i}" for i in range(30)), " ".join(["p q r s t u v w x"] * 5), "ÀÉ Ü straße\u00a0eins\u2003zwei",
    "\x0b\x0cform\x0bfeed\x1cnot space", " ".join(f"w{i % 7}" for i in range(21)), "THE END " * 12,
]


def rows(spark, texts):
    data = [(i, t, f"extra{i}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, n_words string, _w long")


def test_ledger_equals_sql(spark):
    long = " ".join(f"v{i % 900}" for i in range(40_000))
    texts = [*TEXTS, long, TEXTS[3], TEXTS[3]]
    df = rows(spark, texts)
    got = quality_rules.verdicts(df).toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    want = con.execute(OP1_SQL).df().sort_values("doc_id", ignore_index=True)
    assert list(got.columns) == list(want.columns)
    for c in got.columns:
        assert got[c].tolist() == want[c].tolist(), c


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)})


def test_repeat_words_by_hand(spark):
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.verdicts(rows(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        words = (t or "").encode().split()
        assert got[i] == brute_repeats(words), t


def test_policies_and_ablations(spark):
    ledger = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 4), (4, 4), (5, 7)], "doc_id long, fail_bits long")
    p = quality_rules.Policy("p", ("few_words", "symbols"))
    kept = quality_rules.apply_policies(ledger, [p]).filter("kept_p").select("doc_id").collect()
    assert [r[0] for r in kept] == [0]
    got = {r.rule: r for r in quality_rules.ablations(ledger, [p]).collect()}
    assert got["few_words"].asDict() == {
        "version": "p", "rule": "few_words", "failed": 3, "failed_alone": 2, "kept": 1, "kept_without": 3
    }
    assert got["symbols"].kept_without == 3


def test_empty_ledger(spark):
    df = rows(spark, []).select("doc_id", "text")
    assert quality_rules.verdicts(df).count() == 0
    assert quality_rules.ablations(quality_rules.build_ledger(df), [quality_rules.STRICT]).count() == 0


URLS = [
    (0, "http://A.org/x", "org", "/x"), (1, None, "", ""), (2, "no scheme", "", ""), (3, "https://b.example.org/es/1?q#f", 0, 0),
    (4, "x://example.org/en/12", 0, 0), (5, "http://fr.com/fr/", 0, 0), (6, "http://com/de/?x", 0, 0), (7, "http://acom/de/", 0, 0),
    (8, "http://h.net?p://q/", 0, 0), (9, "a\nb://H.net/p\nq?r", 0, 0),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u, *_ in URLS], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in link_trust.judge(pages).collect()}
    seen = {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert seen[0] == ("a.org", "/x", "org/", "allow")
    assert seen[1] == seen[2] == ("", "", None, "allow")
    assert seen[3] == ("b.example.org", "/es/1", "example.org/es/", "block")
    assert seen[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert seen[5][2:] == ("com/fr/", "allow")
    assert seen[6] == ("com", "/de/", "com/de/", "block")
    assert seen[7][2] is None
    assert seen[8][:2] == ("h.net", "")
    assert seen[9][:2] == ("h.net", "/p\nq")


def brute_rank(edges, seeds, damping, rounds):
    hosts = {h for e in edges for h in e} | set(seeds)
    total = sum(seeds.values())
    base = {h: seeds.get(h, 0) / total for h in hosts}
    out = {h: sorted({d for s, d in edges if s == h}) for h in hosts}
    score = dict(base)
    for _ in range(rounds):
        got = dict.fromkeys(hosts, 0.0)
        for h in hosts:
            for d in out[h]:
                got[d] += damping * score[h] / len(out[h])
        lost = 1 - sum(got.values())
        score = {h: got[h] + base[h] * lost for h in hosts}
    return score


def test_spread_equals_brute_force(spark):
    edges = [(f"h{i % 7}", f"h{(i * i + 3) % 11}") for i in range(40) if i % 7 != (i * i + 3) % 11]
    df = spark.createDataFrame(sorted(set(edges)), "src string, dst string")
    seeds = {"h1": 2, "h5": 1}
    got = link_trust.spread(
        df, spark.createDataFrame(list(seeds.items()), "host string, weight long"), rounds=8, tolerance=0.0
    )
    got = {r.host: r.score for r in got.collect()}
    want = brute_rank(set(edges), seeds, 0.85, 8)
    assert all(got.get(h, 0.0) == pytest.approx(v) for h, v in want.items())


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    link = '<a href="//bad.com/de/1">x</a><a class=y HREF=\'http://BAD.com/\'>z</a><a href="/own">o</a>'
    pages = [
        Row(page_id=1, url="http://bad.com/de/", html=""), Row(page_id=2, url="http://spam.net/", html=link),
        Row(page_id=3, url="http://good.org/", html='<a href="http://fine.net/a">f</a>'),
        Row(page_id=4, url="http://fine.net/", html=None), Row(page_id=5, url="http://bad.com/en/", html=""),
    ]
    got = {r.page_id: r.verdict for r in link_trust.judge(spark.createDataFrame(pages)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}
    assert link_trust.judge(spark.createDataFrame(pages).filter("page_id < 0")).count() == 0


def test_no_python_in_the_native_plans(spark, tmp_path):
    plans = [
        quality_rules.verdicts(rows(spark, TEXTS)),
        link_trust.host_edges(spark.createDataFrame([("h", "<a href=//x.y>")], "host string, html string")),
    ]
    for df in plans:
        text = df._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text
    assert plans[0].select(F.sum("n_words")).first()[0] > 0
