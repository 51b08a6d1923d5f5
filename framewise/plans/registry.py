"""Registration of queries next to the SQL an independent engine checks them with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
# no short decimal number lies this far from a tie
SHIFT = 1.23456789e-4


def r(c: Column, digits: int = DIGITS) -> Column:
    """Rounded the same way in both engines, and never a negative zero.

    The tiny shift keeps values that sit exactly between two roundings, which are
    common in made-up data, away from the tie.
    """
    scale = 10.0**digits
    return F.rint(c.cast("double") * scale - SHIFT) / scale + F.lit(0.0)


def rs(expr: str, digits: int = DIGITS) -> str:
    """The same in SQL."""
    return f"round(cast({expr} as double) * 1e{digits} - {SHIFT}) / 1e{digits} + 0e0"


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may refer to the named views."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = with_views(tuple(views), sql)
        return fn

    return register


def project(
    name: str, view: str, keys: Sequence[str], columns: Callable[[], dict[str, Column]],
    sql: dict[str, str], where: tuple[Callable[[], Column], str] | None = None,
    sql_from: str | None = None, source: Callable[[Tables], DataFrame] | None = None,
    views: Sequence[str] | None = None,
) -> None:
    """Register a row-wise query: output name -> Spark column, and the same in SQL.

    ``columns`` is a function, as columns need a session. ``source`` and ``sql_from``
    replace the plain view where a join comes first.
    """
    def run(t: Tables) -> DataFrame:
        df = source(t) if source else t.view(view)
        if where is not None:
            df = df.filter(where[0]())
        return df.select(*keys, *(r(c).alias(n) for n, c in columns().items()))

    listed = ", ".join([*keys, *(f"{rs(e)} AS {n}" for n, e in sql.items())])
    body = f"SELECT {listed} FROM {sql_from or view}"
    if where is not None:
        body += f" WHERE {where[1]}"
    query(name, body, (view,) if views is None else views)(run)
