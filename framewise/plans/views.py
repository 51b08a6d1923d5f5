"""Perception tables derived from the driver tables.

Each view is one projection over a base table. Expressions are plain SQL that Spark
and DuckDB read alike, so the oracle derives exactly the same rows; list expressions
differ in syntax and are given for both.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_DET_ID = "(l_suppkey % 33554432) * 137438953472 + l_partkey * 8 + l_linenumber"
_BOX = {
    "xmin": "(l_partkey % 40) * 10e0",
    "ymin": "(l_suppkey % 20) * 10e0",
    "xmax": "(l_partkey % 40) * 10e0 + 40e0 + l_quantity * 4e0",
    "ymax": "(l_suppkey % 20) * 10e0 + 40e0 + l_tax * 2000e0",
}

# view -> (base table, {column: expression}, filter)
PROJECTIONS: dict[str, tuple[str, dict[str, str], str | None]] = {
    "v_det": (
        "lineitem",
        {
            "frame": "l_orderkey",
            "det_id": _DET_ID,
            "label": "l_suppkey % 14",
            "score": "l_extendedprice / 105000e0",
            **_BOX,
        },
        None,
    ),
    "v_pair": (
        "lineitem",
        {
            "frame": "l_orderkey",
            "det_id": _DET_ID,
            "score": "l_extendedprice / 105000e0",
            **_BOX,
            "b_xmin": "(l_partkey % 40) * 10e0 + l_linenumber * 6e0",
            "b_ymin": "(l_suppkey % 20) * 10e0 + l_quantity",
            "b_xmax": "(l_partkey % 40) * 10e0 + l_linenumber * 6e0 + 90e0",
            "b_ymax": "(l_suppkey % 20) * 10e0 + l_quantity + 70e0 + l_discount * 300e0",
        },
        None,
    ),
    "v_gt": (
        "lineitem",
        {
            "frame": "l_orderkey",
            "gt_id": _DET_ID,
            "label": "l_suppkey % 14",
            **{k: f"{v} + l_discount * 100e0" for k, v in _BOX.items()},
            "difficult": "(l_linestatus = 'O' and l_linenumber = 7)",
        },
        "l_returnflag = 'R'",
    ),
    "v_offset": (
        "lineitem",
        {
            "frame": "l_orderkey",
            "det_id": _DET_ID,
            "anchor_id": "l_partkey % 144",
            "score": "l_extendedprice / 105000e0",
            "label": "l_suppkey % 14",
            "o0": "l_discount",
            "o1": "l_tax",
            "o2": "(l_quantity - 25e0) / 100e0",
            "o3": "(l_linenumber - 4) / 10e0",
        },
        None,
    ),
    "v_pts": (
        "lineitem",
        {
            "frame": "l_suppkey",
            "pt_id": "(l_partkey % 524288) * 8796093022208 + l_orderkey * 8 + l_linenumber",
            "x": "(l_quantity - 25.5e0) / 5e0",
            "y": "(l_extendedprice - 53000e0) / 10000e0",
            "z": "l_discount * 20e0 + l_tax * 10e0",
        },
        None,
    ),
    "v_uv": (
        "lineitem",
        {
            "frame": "l_orderkey",
            "pt_id": _DET_ID,
            "u": "((l_partkey * 7) % 440) * 1e0",
            "v": "((l_suppkey * 13) % 300) * 1e0",
        },
        None,
    ),
    "v_depth": (
        "lineitem",
        {
            "frame": "l_orderkey",
            "pt_id": _DET_ID,
            "camera": "l_suppkey % 4",
            "u": "l_partkey % 848",
            "v": "(l_suppkey * 4) % 480",
            "d": "cast(floor(l_extendedprice / 8e0) as bigint)",
        },
        None,
    ),
}

# view -> (Spark select list, DuckDB select list) over one base table
_EMB = "transform(embedding, x -> cast(x as double))"
_DEMB = "[e::DOUBLE for e in embedding]"
_CROP = "cast(floor(vec_id / 17e0) as bigint)"
_US = ("unix_micros(cast(ts as timestamp))", "epoch_us(ts)")


def _both(base: str, columns: dict[str, tuple[str, str] | str]) -> tuple[str, list[str], list[str]]:
    spark = [f"{c if isinstance(c, str) else c[0]} AS {n}" for n, c in columns.items()]
    duck = [f"{c if isinstance(c, str) else c[1]} AS {n}" for n, c in columns.items()]
    return base, spark, duck


def _e(i: int) -> tuple[str, str]:
    return f"cast(embedding[{i}] as double)", f"cast(embedding[{i + 1}] as double)"


def _of(i: int, form: str) -> tuple[str, str]:
    a, b = _e(i)
    return form.format(a), form.format(b)


DIALECTS: dict[str, tuple[str, list[str], list[str]]] = {
    "v_logits": _both(
        "embeddings",
        {
            "vec_id": "vec_id",
            "label": "label",
            "logits": (f"slice({_EMB}, 1, 32)", f"({_DEMB})[1:32]"),
            "other": (f"slice({_EMB}, 33, 32)", f"({_DEMB})[33:64]"),
            "scores": (f"slice({_EMB}, 1, 10)", f"({_DEMB})[1:10]"),
        },
    ),
    "v_heat": _both(
        "embeddings",
        {
            "crop": _CROP,
            "kp_idx": "cast(vec_id % 17 as int)",
            "hm": (f"transform({_EMB}, x -> abs(x))", "[abs(e::DOUBLE) for e in embedding]"),
        },
    ),
    "v_kp": _both(
        "embeddings",
        {
            "person": _CROP,
            "kp_idx": "cast(vec_id % 17 as int)",
            "x": _of(0, "100e0 * {}"),
            "y": _of(1, "100e0 * {}"),
            "conf": tuple(
                f"case when abs({c}) < 0.02e0 then 0e0 else abs({c}) end" for c in _e(2)
            ),
            "cov_xx": _of(3, "1e0 + 10e0 * abs({})"),
            "cov_xy": _of(4, "{} * 1e0"),
            "cov_yy": _of(5, "1e0 + 10e0 * abs({})"),
            "depth": _of(6, "2e0 + 4e0 * {}"),
            "x2": tuple(f"100e0 * {a} + 20e0 * {b}" for a, b in zip(_e(0), _e(7))),
            "y2": tuple(f"100e0 * {a} + 20e0 * {b}" for a, b in zip(_e(1), _e(8))),
            "conf2": tuple(
                f"case when abs({c}) < 0.02e0 then 0e0 else abs({c}) end" for c in _e(9)
            ),
            "hidden": _of(10, "({} > 0.1e0)"),
        },
    ),
    "v_tensor": _both(
        "embeddings",
        {
            "iteration": "vec_id",
            "output": "'e'",
            "at": (f"posexplode({_EMB})", "unnest(range(len(embedding)))"),
        },
    ),
    "v_trace": _both(
        "events",
        {
            "event_id": "event_id",
            "stage": "event_type",
            "start_ms": tuple(f"({u} - 1704067200000000) / 1000e0" for u in _US),
            "compute": "value",
            "latency": "value * 1.15e0",
            "e2e": "value * 1.15e0 + (event_id % 7) * 0.5e0",
            "enqueue": "value * 0.1e0",
            "n_det": "user_id % 10",
        },
    ),
    "v_events": _both(
        "events",
        {
            "event_id": "event_id",
            "user_id": "user_id",
            "camera": "user_id % 16",
            "topic": "event_type",
            "ts": "ts",
            "us": _US,
            "value": "value",
        },
    ),
}
# v_tensor spreads an array into rows, which the two dialects write differently
DIALECTS["v_tensor"] = (
    "embeddings",
    ["vec_id AS iteration", "'e' AS output", f"posexplode({_EMB}) AS (idx, val)"],
    [
        "vec_id AS iteration",
        "'e' AS output",
        "unnest(range(len(embedding))) AS idx",
        "unnest(embedding)::DOUBLE AS val",
    ],
)


def duck_view(name: str) -> str:
    """The view's query for DuckDB."""
    if name in PROJECTIONS:
        base, columns, where = PROJECTIONS[name]
        listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        return f"SELECT {listed} FROM {base}" + (f" WHERE {where}" if where else "")
    base, _, duck = DIALECTS[name]
    return f"SELECT {', '.join(duck)} FROM {base}"


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` with the named views in front; the body may go on with its own CTEs."""
    ctes = ", ".join(f"{n} AS ({duck_view(n)})" for n in names)
    if not ctes:
        return body
    text = body.strip()
    for word in ("WITH RECURSIVE", "WITH"):
        if text.startswith(word):
            return f"{word} {ctes}, {text[len(word):]}"
    return f"WITH {ctes} {text}"


@dataclass(frozen=True)
class Tables:
    """The driver tables of one folder and the views over them."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name in PROJECTIONS:
            base, columns, where = PROJECTIONS[name]
            df = self.table(base)
            df = df.filter(where) if where else df
            return df.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))
        base, spark, _ = DIALECTS[name]
        return self.table(base).selectExpr(*spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in PROJECTIONS or name in DIALECTS:
            return self.view(name)
        raise AttributeError(name)

    @cached_property
    def persons(self) -> DataFrame:
        """One row per person with its 17 keypoints in order."""
        kp = F.struct(
            "x", "y", "conf", "cov_xx", "cov_xy", "cov_yy",
            F.col("hidden").alias("occluded"),
        )
        kp2 = F.struct(
            F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("conf2").alias("conf"),
            "cov_xx", "cov_xy", "cov_yy", F.col("hidden").alias("occluded"),
        )
        listed = self.v_kp.groupBy("person").agg(
            F.array_sort(F.collect_list(F.struct("kp_idx", kp.alias("a"), kp2.alias("b")))).alias("l")
        )
        return listed.select(
            "person", F.transform("l", lambda s: s["a"]).alias("kps"),
            F.transform("l", lambda s: s["b"]).alias("kps2"),
        )
