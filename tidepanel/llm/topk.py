"""Exact top-k inner products by multi-resolution segment statistics.

For a query q and a candidate x cut into the same segments of l components, with segment means m and deviations s,
the squared distance is at least the sum of l * ((m_q - m_x)^2 + (s_q - s_x)^2); with the norms, which are known,
that lower bound of the distance is an upper bound of the inner product. Bounds are computed from one segment to
segments of two components; a pair whose bound lies below the query's k-th best score so far is dropped, and the
exact product is computed for the survivors.

Queries meet candidates in tiles of bounded size, dealt over the cluster by row number, not by id or value, so that
equal rows spread; each tile returns at most k rows per query, and a ranking over tiles keeps the best k.

Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id. A query is
compared with the rows of its own length whose id differs from its own. Repeated query rows get a list each, repeated
candidate rows a place each. Ties go to the smaller id. Scores beyond the range of a long are held at its ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

#: Rows of a tile's sides, and of the blocks a tile is worked in.
QUERY_TILE, ROW_TILE, QUERY_STEP, ROW_STEP = 2048, 8192, 512, 2048
LONGEST = (1 << 63) - 1


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, each times the root of its length: their products are the bound."""
    borders = np.linspace(0, x.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(borders[:-1], borders[1:]):
        part = x[:, a:b]
        out += [part.mean(1) * math.sqrt(b - a), part.std(1) * math.sqrt(b - a)]
    return np.column_stack(out)


def products(q: np.ndarray, x: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Inner products where ``alive``; elsewhere anything or -inf."""
    if alive.mean() > 0.05:
        return q @ x.T
    out = np.full(alive.shape, -np.inf)
    a, b = np.nonzero(alive)
    out[a, b] = np.einsum("ij,ij->i", q[a], x[b])
    return out


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """(query row, id, score) of the k best rows of x for each row of q; integer-valued doubles in, longs out."""
    if not len(q) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = np.linalg.norm(q, axis=1).max() * np.linalg.norm(x, axis=1).max()
    if not reach < 2.0 ** 52:
        return _large(q, q_ids, x, x_ids, k)
    levels = [1 << e for e in range(20) if 1 << e <= max(1, x.shape[1] // 2)]
    if not x.shape[1]:
        levels = []
    q_stats, x_stats = [statistics(q, m) for m in levels], [statistics(x, m) for m in levels]
    slack = 1e-9 * reach + 1e-6
    found = []
    for i in range(0, len(q), QUERY_STEP):
        rows = slice(i, i + QUERY_STEP)
        held = (np.zeros(0, np.int64),) * 3                       # (row, id, score)
        least = np.full(len(q[rows]), -np.inf)                    # k-th best so far
        # Candidates with a large coarse bound first: the k-th best grows early.
        order = np.argsort(-x_stats[0][:, 1], kind="stable") if levels else np.arange(len(x))
        for j in range(0, len(x), ROW_STEP):
            cols = order[j:j + ROW_STEP]
            alive = q_ids[rows][:, None] != x_ids[cols][None, :]
            for a, b in zip(q_stats, x_stats):
                if not np.isfinite(least).any() or not alive.any():
                    break
                alive &= products(a[rows], b[cols], alive) >= least[:, None] - slack
            score = np.where(alive, products(q[rows], x[cols], alive), -np.inf)
            score[score < least[:, None]] = -np.inf
            if score.shape[1] > k:
                kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                take = np.isfinite(score) & (score >= kth[:, None])
            else:
                take = np.isfinite(score)
            r, c = np.nonzero(take)
            held = _first(np.concatenate([held[0], r]), np.concatenate([held[1], x_ids[cols][c]]),
                          np.concatenate([held[2], score[r, c].astype(np.int64)]), k)
            n = np.bincount(held[0], minlength=len(least))
            ends = np.cumsum(n)
            full = n >= k
            least[full] = held[2][ends[full] - 1]
        found.append((held[0] + i, held[1], held[2]))
    return tuple(np.concatenate(p) for p in zip(*found))


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k first of each row by score downwards, then id."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    begin = np.searchsorted(row, row)
    keep = np.arange(len(row)) - begin < k
    return row[keep], ids[keep], score[keep]


def _large(q, q_ids, x, x_ids, k):
    """Whole numbers beyond a double's exact range: Python integers, in small blocks."""
    found = []
    whole = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    x = whole(x)
    for i in range(len(q)):
        score = (x * whole(q[i:i + 1])).sum(1) if x.shape[1] else np.zeros(len(x), object)
        ranked = sorted((-s, d) for s, d in zip(score, x_ids.tolist()) if d != q_ids[i])[:k]
        found += [(i, d, max(-LONGEST - 1, min(LONGEST, -s))) for s, d in ranked]
    row, ids, score = zip(*found) if found else ((), (), ())
    return tuple(np.array(v, np.int64) for v in (row, ids, score))


def _matrix(table: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = table.column("v").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        x = np.floor(scale * values.reshape(len(table), -1) if len(values) else np.zeros((len(table), 0)))
    x = np.clip(x, -np.finfo(np.float64).max, np.finfo(np.float64).max)
    return table.column("row").to_numpy(), table.column("id").to_numpy(), x


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the largest integer inner products, for every query row.

    Components become floor(scale * x). ``is_query`` is a condition on the columns of ``vectors``.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Row numbers follow the files' splits: equal when a lost task is run again, and blind to what a row holds.
    rows = stored(vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), v.alias("v"),
        F.size(vector_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("q")), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    deal = lambda tiles: F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int")
    tiles, query_tiles = max(1, math.ceil(n / ROW_TILE)), max(1, math.ceil(n_queries / QUERY_TILE))
    every = lambda tiles: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = rows.where("q").select("row", "id", "v", "dim", deal(query_tiles).alias("a")).withColumn("b", every(tiles))
    right = rows.select("row", "id", "v", "dim", deal(tiles).alias("b")).withColumn("a", every(query_tiles))

    def tile(queries: pa.Table, others: pa.Table) -> pa.Table:
        q_rows, q_ids, q = _matrix(queries, scale)
        _, x_ids, x = _matrix(others, scale)
        at, ids, score = best(q, q_ids, x, x_ids, k) if len(q) and len(x) else (np.zeros(0, np.int64),) * 3
        return pa.table({"row": pa.array(q_rows[at], pa.int64()), "query_id": pa.array(q_ids[at], pa.int64()),
                         "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

    keys = ("dim", "a", "b")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        tile, "row long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
