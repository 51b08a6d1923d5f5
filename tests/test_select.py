"""Rows at sorted positions and first rows without ranking or gathering everything; shared folder."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewise.operators import aggregate
from framewise.operators.scale import rows_at


def table(spark, n=3000):
    rng = np.random.default_rng(6)
    key = np.where(rng.random(n) < 0.8, 0, rng.integers(1, 9, n))
    v = np.where(rng.random(n) < 0.4, 5.0, rng.normal(0, 50, n).round(1))
    pdf = pd.DataFrame({"k": key, "v": v, "id": np.arange(n), "note": "x"})
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    pdf["k"] = pdf["k"].where(pdf["k"] != 7, -1)
    return df.withColumn("v", F.when(F.col("id") % 97 != 0, F.col("v"))), pdf.assign(v=pdf["v"].where(pdf["id"] % 97 != 0, -np.inf))


def test_rows_at_equal_the_sorted_positions(spark):
    df, pdf = table(spark)
    wanted = {"first": lambda n: n * 0, "third": lambda n: F.floor(n / 3), "last": lambda n: n - 1, "none": lambda n: n}
    got = {(r.k if r.k is not None else -1, r.rule): (r.id, r.n) for r in rows_at(df, ["k"], ["v", "id"], wanted).collect()}
    want = {}
    for k, part in pdf.groupby("k"):
        ids = part.sort_values(["v", "id"])["id"].tolist()
        n = len(ids)
        want |= {(k, "first"): (ids[0], n), (k, "third"): (ids[n // 3], n), (k, "last"): (ids[-1], n)}
    assert got == want
    whole = pdf.sort_values(["v", "id"])["id"].tolist()
    (row,) = rows_at(df, [], ["v", "id"], {"x": lambda n: F.floor(n / 2)}).collect()
    assert (row.id, row.n) == (whole[len(whole) // 2], len(whole))


@pytest.mark.parametrize("take, batch", [(1, None), (1000, None), (2999, None), (5000, None), (1234, 100), (5000, 700)])
def test_first_rows_by_buckets_equal_the_sort(spark, take, batch):
    df, pdf = table(spark)
    got = aggregate.limit_rows(df, ["v", "id"], take, batch, small=0)
    n = min(take, len(pdf))
    n = n // batch * batch if batch else n
    assert [r.id for r in got.select("id").collect()] == pdf.sort_values(["v", "id"])["id"].tolist()[:n]
    assert "GlobalLimit" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_session_without_a_named_folder_gets_one(tmp_path):
    code = (
        "from framewise.session import local_session, cut_lineage, shared_dir\n"
        "s = local_session('plain', 1)\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert cut_lineage(s.range(5)).count() == 5 and shared_dir(s) == shared_dir(s)\n"
        "from framewise.operators.neighbours import components\n"
        "assert components(s.createDataFrame([(1, 2), (2, 3)], 'a int, b int'), []).count() == 3\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
