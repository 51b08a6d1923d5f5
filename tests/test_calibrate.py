import math

import numpy as np
import pytest

from framewise.operators import calibrate


def dense(row):
    counts = np.zeros(row["n_bins"])
    for b, c in row["filled"]:
        counts[b] = c
    return counts, row["low"] + row["width"] * np.arange(row["n_bins"] + 1)


def least_error(counts, edges, bits, unsigned, start, stride):
    """Every bin's centre as clipping value, over all bins."""
    centers = (edges[1:] + edges[:-1]) / 2
    top = 2 ** (bits - 1 + int(unsigned)) - 1
    best = (math.inf, math.nan)
    for i in range(start, len(centers), stride):
        shown = np.clip(np.rint(centers * top / centers[i]), 0 if unsigned else -top, top) * centers[i] / top
        best = min(best, (float((counts * (shown - centers) ** 2).sum()), centers[i]), key=lambda x: x[0])
    return best[1]


def least_divergence(counts, edges, bits, unsigned, start, stride):
    """Every edge as clipping value, over all bins; the last of equals."""
    counts = counts.copy()
    counts[0] = counts[1]
    levels = 2 ** (bits - 1 + int(unsigned))
    best = (math.inf, math.nan)
    for stop in range(start, len(counts) + 1, stride):
        shown = np.zeros(stop)
        group = np.minimum(np.arange(stop) * levels // stop, levels - 1)
        for g in np.unique(group):
            inside = (group == g) & (counts[:stop] > 0)
            if inside.any():
                shown[inside] = counts[:stop][inside].mean()
        clipped = counts[:stop].copy()
        clipped[-1] += counts[stop:].sum()
        if not shown.any():
            continue
        p, q = clipped / clipped.sum(), shown / shown.sum()
        on = p > 0
        d = math.inf if (q[on] == 0).any() else float((p[on] * np.log(p[on] / q[on])).sum())
        if d <= best[0] + 1e-13:
            best = (d, edges[stop])
    return best[1]


BRUTE = {"mse": least_error, "entropy": least_divergence}


def histograms(seed):
    rnd = np.random.default_rng(seed)
    for i, (n_bins, share) in enumerate([(300, 1.0), (300, 0.3), (700, 0.05), (40, 1.0), (900, 0.9), (200, 0.0)]):
        shape = np.exp(-np.arange(n_bins) / (n_bins / rnd.uniform(3, 9))) * 5000
        counts = np.where(rnd.random(n_bins) < share, rnd.poisson(shape) + 1, 0)
        counts[rnd.integers(2, n_bins)] += 7
        filled = [(int(b), int(counts[b])) for b in np.flatnonzero(counts)]
        yield {"name": f"t{i}", "low": float(i) / 10, "width": 0.5 / n_bins, "n_bins": n_bins, "filled": filled}


def as_table(spark, rows):
    data = [(r["name"], r["low"], r["width"], r["n_bins"], b, c) for r in rows for b, c in r["filled"]]
    return spark.createDataFrame(data, "name string, low double, width double, n_bins long, bin long, count long")


@pytest.mark.parametrize("method", ["mse", "entropy"])
@pytest.mark.parametrize(("bits", "unsigned", "stride", "work"), [(8, False, 1, 1 << 24), (4, True, 3, 2_000), (5, False, 1, 500)])
def test_clipping_values_equal_brute_force(spark, monkeypatch, method, bits, unsigned, stride, work):
    monkeypatch.setattr(calibrate, "WORK", work)
    rows = list(histograms(bits))
    table = as_table(spark, rows)
    got = {r["name"]: r["amax"] for r in calibrate.amax(table, ["name"], method, bits=bits, unsigned=unsigned, start=48, stride=stride).collect()}
    assert set(got) == {r["name"] for r in rows}
    for r in rows:
        want = BRUTE[method](*dense(r), bits, unsigned, 48, stride)
        assert got[r["name"]] is None if math.isnan(want) else math.isclose(got[r["name"]], want, rel_tol=1e-12), r["name"]


def test_a_long_histogram_is_dealt_over_tasks(spark):
    rnd = np.random.default_rng(1)
    n_bins = 1 << 22  # far outliers lengthen the range; what is filled counts
    at = np.unique(np.concatenate([rnd.integers(0, 40_000, 30_000), [n_bins - 1]]))
    rows = [{"name": "t", "low": 0.0, "width": 1e-4, "n_bins": n_bins, "filled": [(int(b), 3) for b in at]}]
    table = as_table(spark, rows)
    parts = calibrate._parts(table, ["name"], 128, 64, 0, 1024)
    bounds = sorted((r["from"], r["to"]) for r in parts.select("from", "to").collect())
    assert len(bounds) > 1 and bounds[0][0] == 0 and bounds[-1][1] == -(-(n_bins - 128) // 64)
    assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    got = calibrate.amax(table, ["name"], "mse", start=128, stride=64).first()["amax"]
    x = (at + 0.5) * 1e-4
    tried = (np.arange(128, n_bins, 64) + 0.5) * 1e-4
    near = tried[np.abs(tried - got) < 0.2]
    errors = [((np.clip(np.rint(x * 127 / c), -127, 127) * c / 127 - x) ** 2).sum() for c in near]
    assert math.isclose(near[int(np.argmin(errors))], got, rel_tol=1e-9)
    assert calibrate.amax(table.limit(0), ["name"], "entropy").count() == 0
