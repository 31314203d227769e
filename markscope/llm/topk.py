"""Exact top-k search by inner product with multi-resolution segment statistics.

For equal-length vectors, the squared distance |q|^2 + |x|^2 - 2qx falls as the product grows. Cut into
segments of s components with means m and deviations d, it is at least the sum over segments of
s((mq - mx)^2 + (dq - dx)^2). That bound gives an upper bound on the product; it is taken with few
segments first, then with more, and only candidates that may still reach the k-th best product known
to the query are kept, so exact products are computed for survivors alone.

Vectors are scaled to integers, floor(scale * x), so products are exact and ties go to smaller ids.

Queries and candidates meet in tiles: blocks of ``QUERY_BLOCK`` queries by slices of about ``SLICE`` candidates, so that
neither side is broadcast or held whole; each tile gives at most k rows a query, which are ranked at the end.

Cases: vectors that are null, or hold null, NaN or infinite components, take no part; vectors of another length than the
query's are no candidates; rows of a query's id are none either; a repeated query row asks once; fewer than k
candidates give fewer rows; sums beyond 2**53 are computed in Python integers; scaled components and products beyond a long
are held at its ends, where equal ones are ties; ids are whole numbers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 10
SCALE = 1024.0
QUERY_BLOCK = 1024
SLICE = 8192
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Segments of each resolution, coarse to fine.
RESOLUTIONS = (4, 16)


def _segments(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of each vector's segments, and the segments' lengths."""
    edges = np.linspace(0, x.shape[1], min(parts, max(1, x.shape[1])) + 1).astype(int)
    size = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    return mean, np.sqrt(np.maximum(square - mean * mean, 0)), size


def _floor_distance(q: np.ndarray, x: np.ndarray, parts: int) -> np.ndarray:
    """(queries, candidates): a lower bound of the squared distance."""
    mq, dq, size = _segments(q, parts)
    mx, dx, _ = _segments(x, parts)
    root = np.sqrt(size)
    a = np.concatenate((mq * root, dq * root), axis=1)
    b = np.concatenate((mx * root, dx * root), axis=1)
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def best_products(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int = K, resolutions: tuple[int, ...] = RESOLUTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate id, product) of the k best candidates of each query: ties to smaller ids."""
    none = np.zeros(0, np.int64)
    if not len(q) or not len(x):
        return none, none, none
    limit = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if limit >= 2.0**52:
        return _best_in_integers(q_ids, q, ids, x, k)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    q2, x2 = (q * q).sum(1), (x * x).sum(1)
    # the k-th best product among a first few candidates starts each query's threshold
    seed = np.argsort(-x2, kind="stable")[: 4 * k]
    known = (q @ x[seed].T).astype(float)
    known[q_ids[:, None] == ids[seed][None, :]] = -np.inf
    floor = np.sort(known, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(q), -np.inf)
    alive = q_ids[:, None] != ids[None, :]
    slack = 1e-6 * (q2.max() + x2.max() + 1)
    for parts in resolutions:
        rows = np.flatnonzero(alive.any(axis=0))
        top = (q2[:, None] + x2[rows][None, :] - _floor_distance(q, x[rows], parts)) / 2
        alive[:, rows] &= top + slack >= floor[:, None]
    out_q, out_x, out_s = [], [], []
    for i in range(len(q)):
        at = np.flatnonzero(alive[i])
        if not len(at):
            continue
        s = np.rint(x[at] @ q[i]).astype(np.int64)
        best = np.lexsort((ids[at], -s))[:k]
        out_q.append(np.full(len(best), i))
        out_x.append(ids[at][best])
        out_s.append(s[best])
    if not out_q:
        return none, none, none
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)


def _best_in_integers(q_ids, q, ids, x, k):
    rows = [[int(v) for v in r] for r in x.tolist()]
    out: list[tuple[int, int, int]] = []
    for i, r in enumerate(q.tolist()):
        r = [int(v) for v in r]
        got = sorted((-min(max(sum(a * b for a, b in zip(r, c, strict=True)), _LEAST), _MOST), int(n)) for c, n in zip(rows, ids.tolist(), strict=True) if n != q_ids[i])
        out += [(i, n, -s) for s, n in got[:k]]
    return tuple(np.array([o[j] for o in out], object if j == 2 else np.int64) for j in range(3))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score (the integer inner product)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.col(f"`{id_col}`").isNotNull()
    rows = vectors.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda c: F.floor(c * scale).cast("double")).alias("v"), is_query.alias("is_query"))
    rows = rows.withColumn("dim", F.size("v"))
    n = rows.groupBy().agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).first()
    q_blocks, slices = -(-n["q"] // QUERY_BLOCK) or 1, -(-n["n"] // SLICE) or 1
    spread = F.xxhash64("id", F.lit(5))
    queries = rows.where("is_query").dropDuplicates(["id", "v"]).withColumn("qb", F.pmod(spread, F.lit(q_blocks))).withColumn("sl", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    others = rows.withColumn("sl", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(slices))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    key = ["dim", "qb", "sl"]
    queries = queries.select("dim", F.col("qb").cast("long").alias("qb"), F.col("sl").cast("long").alias("sl"), "id", "v")
    others = others.select("dim", F.col("qb").cast("long").alias("qb"), F.col("sl").cast("long").alias("sl"), "id", "v")

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        q_ids, q = _arrays(a)
        ids, x = _arrays(b)
        i, best, s = best_products(q_ids, q, ids, x, k)
        return pa.table({"query_row": pa.array(q_ids[i] if len(i) else i, pa.int64()), "vec_id": pa.array(best, pa.int64()), "score": pa.array(s.tolist(), pa.int64())})

    found = queries.groupBy(*key).cogroup(others.groupBy(*key)).applyInArrow(tile, "query_row long, vec_id long, score long")
    from pyspark.sql import Window

    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("query_row").alias("query_id"), "rank", "vec_id", "score")


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("id").to_numpy()
    if not t.num_rows:
        return ids.astype(np.int64), np.zeros((0, 0))
    flat = t.column("v").combine_chunks().flatten().to_numpy()
    return ids, flat.reshape(t.num_rows, -1)
