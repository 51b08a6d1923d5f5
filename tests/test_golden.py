"""Small cases with known answers."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from framewise.functions import arrays as R
from framewise.functions import boxes as B
from framewise.functions import text as tx
from framewise.functions.boxes import Box
from framewise.operators import aggregate as agg
from framewise.operators import calibrate as cal
from framewise.operators import compare as cmp
from framewise.operators import skeletons as sk
from framewise.operators import textprep as tp
from framewise.sources import readers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit_box(*v):
    return Box(*(F.lit(float(x)) for x in v))


def test_boxes(spark):
    a, far, inner = lit_box(0, 0, 10, 10), lit_box(10, 0, 20, 10), lit_box(2, 2, 4, 4)
    row = one(spark, B.iou(a, a), B.iou(a, far), B.overlap_fraction(inner, a), B.iou(a, far, normalized=False))
    assert row[0] == pytest.approx(1) and row[1] == 0 and row[2] == pytest.approx(1) and row[3] > 0


def test_voxel_borders(spark):
    rows = [(0, -10.0, 0.0, 0.0), (0, 10.0, 0.0, 0.0), (0, 0.0, 0.05, -0.05), (0, 0.04, 0.09, -0.01)]
    df = spark.createDataFrame(rows, "frame long, x double, y double, z double")
    got = {(r.vx, r.vy, r.vz): r.n_points for r in agg.voxel_filter(df).collect()}
    assert got == {(0, 200, 200): 1, (200, 201, 199): 2}


def test_heatmap_peak_corner_and_middle(spark):
    corner, middle = [0.0] * 36, [0.0] * 36
    corner[0] = 0.9
    middle[14], middle[15], middle[8] = 0.9, 0.5, 0.4
    df = spark.createDataFrame([(1, corner), (2, middle)], "crop long, hm array<double>")
    got = {r.crop: (r.x, r.y) for r in sk.heatmap_peaks(df, "hm", 6, 6).collect()}
    assert got == {1: (0.0, 0.0), 2: (2.25, 1.75)}


def test_quantize(spark):
    x = F.explode(F.array(*(F.lit(v) for v in (-2.0, -0.5, 0.5, 1.0, 2.0))))
    df = spark.range(1).select(x.alias("x"))
    got = [tuple(r) for r in df.select(R.quantize(F.col("x"), F.lit(1.0)), R.quantize(F.col("x"), F.lit(0.0)),
                                       R.quantize(F.col("x"), F.lit(1.0), narrow=False)).collect()]
    assert got == [(-127, 0, -128), (-64, 0, -64), (64, 0, 64), (127, 0, 127), (127, 0, 127)]


def test_histogram_grows_by_whole_bins(spark):
    rows = [(0, v / 10) for v in range(11)] + [(1, 1.23), (1, -0.05)]
    df = spark.createDataFrame(rows, "batch int, val double")
    got = cal.histogram(df, [], bins=10, batch="batch").collect()
    assert {r.n_bins for r in got} == {13} and sum(r["count"] for r in got) == 13


def test_topk_longer_than_array(spark):
    row = one(spark, R.topk_indices(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)), 9))
    assert row[0] == [1, 2, 0]


def test_compare_shapes_and_nan(spark):
    schema = "iteration long, output string, idx long, val double"
    a = spark.createDataFrame([(0, "x", 0, 1.0), (0, "x", 1, float("nan")), (1, "x", 0, 1.0)], schema)
    b = spark.createDataFrame([(0, "x", 0, 1.0), (0, "x", 1, float("nan")), (1, "x", 0, 1.0), (1, "x", 1, 2.0)], schema)
    got = {r.iteration: (r.matched, r.shape_mismatch) for r in cmp.compare_runs(a, b).collect()}
    assert got == {0: (False, False), 1: (False, True)}
    assert cmp.pass_rate(cmp.compare_runs(a.limit(0), b.limit(0))).count() == 1


@pytest.mark.parametrize("n,windows", [(0, []), (5, [(0, 5)]), (10, [(0, 10)]), (11, [(0, 10), (4, 7)])])
def test_doc_windows(spark, n, windows):
    df = spark.createDataFrame([(1, [str(i) for i in range(n)])], "doc_id long, l array<string>")
    got = sorted((r.start, r.length) for r in tp.doc_windows(df, "l", 10, 4).collect())
    assert got == windows


def test_wordpiece(spark):
    words = spark.createDataFrame([("unaffable",), ("xyz",), ("un",), ("u" * 201,)], "word string")
    vocab = spark.createDataFrame([(t,) for t in ("un", "##aff", "##able", "##a", "u")], "token string")
    got = {r.word: r.pieces for r in tp.wordpiece(words, vocab).collect()}
    assert got["unaffable"] == ["un", "##aff", "##able"] and got["xyz"] == ["[UNK]"]
    assert got["un"] == ["un"] and got["u" * 201] == ["[UNK]"]


def plain_tokens(text):
    """The rules, character by character."""
    out = []
    for ch in text:
        cat = unicodedata.category(ch)
        if ch in "\t\n\r" or cat == "Zs":
            out.append(" ")
        elif ch == "�" or cat.startswith("C"):
            continue
        elif any(a <= ord(ch) <= b for a, b in tx.CJK_BLOCKS):
            out.append(f" {ch} ")
        else:
            out.append(ch)
    text = unicodedata.normalize("NFD", "".join(out).lower())
    text = "".join(c for c in text if unicodedata.category(c) != "Mn")
    marked = "".join(
        f" {c} " if (33 <= ord(c) <= 126 and not c.isalnum()) or unicodedata.category(c).startswith("P") else c
        for c in text
    )
    return marked.split()


def test_basic_tokenize(spark):
    texts = ["Héllo, Wörld! l'été", "日本 go中国", "a b\tc​d�e", "한국어 test…", "", "Ünï-çode ½ ﬁ Ω"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, t string")
    got = {r.i: r.l for r in df.select("i", tx.basic_tokenize(F.col("t")).alias("l")).collect()}
    for i, s in enumerate(texts):
        assert got[i] == plain_tokens(s), s


def test_generated_inputs_do_not_depend_on_partitions(spark):
    df = readers.generate_inputs(spark, {"x": ("float", 10), "b": ("bool", 4)}, 5, seed=3)
    again = df.repartition(7)
    assert df.exceptAll(again).isEmpty() and df.count() == 70


def test_bad_pair_line_fails(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a|b|c\n")
    with pytest.raises(Exception, match="not two fields"):
        readers.read_pairs(spark, str(tmp_path)).collect()
