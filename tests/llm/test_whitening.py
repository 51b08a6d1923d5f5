import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import symmetric_eigen, whitening


def usable(v):
    return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)


def check(spark, df, k=32):
    got = whitening.whitened(df, k=k).toPandas()
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect() if usable(r.embedding)]
    x = np.array([[int(np.floor(float(c) * 64)) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(rows), x.sum(axis=0)
    far = x * n - s
    y = (far / n).astype(float)
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    use = min(k, int((values > 1e-12 * np.trace(cov)).sum()))
    assert len(got) == n * use
    assert set(got["component"]) == set(range(1, use + 1))
    want = sorted((-1 if i is None else i, int((f * f).sum())) for (i, _), f in zip(rows, far))
    found = got[got["component"] == 1]
    assert sorted((int(i) if i == i else -1, int(d)) for i, d in zip(found["vec_id"], found["deviation"])) == want
    assert (got["n"] == n).all() and (got["identity_error"] < 1e-9).all()
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values[:use] / np.trace(cov), rtol=1e-10)
    return got, rows, y, values, vectors


def test_equals_the_eigenvectors_of_numpy(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got, rows, y, values, vectors = check(spark, df)
    ids = [i for i, _ in rows]
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = y @ vectors[:, :32] / np.sqrt(values[:32])
    sign = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * sign, atol=1e-7)


def test_unusable_rows_repeats_and_other_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    rows += [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [float("nan")] * 4), (53, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [rows[0], rows[0], (None, [0.5, 0.25, 1.0, 2.0]), (54, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, deviation string")
    check(spark, df)
    # other lengths than most have are left out
    more = df.unionByName(spark.createDataFrame([(90, [1.0, 2.0], 1, "x"), (91, [1.0] * 5, 1, "x")], df.schema))
    assert whitening.whitened(more).count() == whitening.whitened(df).count()


def test_equal_eigenvalues_and_missing_variance(spark):
    corners = [[a, b, c, 0.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    df = spark.createDataFrame(list(enumerate(corners)), "vec_id long, embedding array<double>")
    got, *_ = check(spark, df)
    assert len(got) == 8 * 3
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(same).count() == 0
    assert whitening.whitened(same.limit(0)).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 0.5]), (3, [0.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(c * 64) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    _, far = whitening.centred(np.array(x, np.int64), 3, sums)
    assert [int(f) for f in far] == want
    with pytest.raises(Exception):  # more than 64 bits hold
        whitening.whitened(df).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64])
def test_eigen_solver(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    for spectrum in (rng.random(n), np.ones(n), np.r_[np.ones(n - 1), 5.0], 10.0 ** -np.arange(n), np.repeat([3.0, 1.0], n)[:n]):
        a = q @ np.diag(spectrum) @ q.T
        values, vectors = symmetric_eigen.leading((a + a.T) / 2, n)
        assert np.allclose(values, np.sort(spectrum)[::-1], rtol=1e-9, atol=1e-13 * spectrum.max())
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-10)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-10 * spectrum.max())
