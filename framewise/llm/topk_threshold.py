"""Exact top-k search by Fagin's threshold algorithm.

The vectors are dealt into blocks of bounded size by a hash. In a block every dimension has a
list of its rows sorted by value. A query walks all lists at once, each from the end that its
own component favours; a row met for the first time is scored in full. The best score a row not
yet met can have is the sum of what the lists show at the depth reached; once the k-th result
is above that bound, the walk ends. The k best of each block are merged per query.

The queries are a stated set. They come in blocks too, so a task holds one block of either.

Cases: vectors that are NULL or hold a NULL or a number that is not finite, and rows without id,
take no part; equal rows count once; if one id has several vectors, each is a candidate, and the
smallest is the query of that id; a shorter vector is zero beyond its end; an empty vector scores
0 with all; fewer candidates than k give fewer rows; ties go to the smaller id; an empty table
gives no rows; further columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.session import cut_lineage

BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048
SCALE = 1024
FIRST_STEP = 16


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x); NULL where the vector takes no part."""
    top = F.lit(float("inf"))
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < top)
    )
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Lists:
    """The rows of one block with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").T  # dimension x place, rising
        self.largest = int(np.abs(rows).max(initial=0))
        self.floats = rows.astype(np.float64)

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; in floating point where no sum can leave 53 bits."""
        bound = self.largest * int(np.abs(query).max(initial=0)) * max(1, len(query))
        if bound < 1 << 53:
            return (self.floats[at] @ query.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ query

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best, best first, and how deep the walk went."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        if len(dims) == 0:  # every row scores 0: the smallest ids win
            at = np.flatnonzero(self.ids != own)
            at = at[np.argsort(self.ids[at], kind="stable")[:k]]
            return self.ids[at], np.zeros(len(at), np.int64), 0
        up = query[dims] > 0
        seen = self.ids == own
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, FIRST_STEP
        while depth < n:
            end = min(n, depth + step)
            high = self.order[dims[up], n - end : n - depth]
            low = self.order[dims[~up], depth:end]
            new = np.concatenate([high.ravel(), low.ravel()])
            new = np.unique(new[~seen[new]])
            seen[new] = True
            ids = np.concatenate([ids, self.ids[new]])
            scores = np.concatenate([scores, self.scores(new, query)])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            shown = np.empty(len(dims), np.int64)
            shown[up] = self.rows[self.order[dims[up], n - end], dims[up]]
            shown[~up] = self.rows[self.order[dims[~up], end - 1], dims[~up]]
            depth, step = end, step * 2
            if len(ids) == k and scores[-1] > int(query[dims] @ shown):
                break
        return ids, scores, depth


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _searcher(k: int):
    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(queries):
            width = max(rows["v"].map(len).max(), queries["v"].map(len).max())
            lists = Lists(rows["id"].to_numpy(np.int64), _matrix(rows["v"], width))
            for own, q in zip(queries["id"].to_numpy(np.int64), _matrix(queries["v"], width), strict=True):
                ids, scores, _ = lists.top(q, own, k)
                found.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        if not found:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        return pd.concat(found, ignore_index=True)

    return search


def top_k(
    df: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", every: int = 100,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for each row whose id is divisible by ``every``."""
    rows = df.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("v"))
    rows = cut_lineage(rows.filter("id IS NOT NULL AND v IS NOT NULL").distinct())
    asking = cut_lineage(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    n, m = rows.count(), asking.count()
    blocks, query_blocks = -(-max(n, 1) // block_rows), -(-max(m, 1) // block_queries)

    def dealt(frame: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return frame.withColumn(own, F.pmod(F.xxhash64("id", "v"), F.lit(parts))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        )

    left = dealt(rows, "b", blocks, "q", query_blocks).groupBy("b", "q")
    right = dealt(asking, "q", query_blocks, "b", blocks).groupBy("b", "q")
    found = left.cogroup(right).applyInPandas(_searcher(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
