"""Nearest neighbours by a block matrix join (operator 10).

Candidates and queries are cut into blocks; a cell of the block matrix is one
cogroup of a candidate block with a query block.  In a cell, vectors are
quantised to int8 with one scale per vector; products of int8 tiles give every
inner product together with a bound of its quantisation error.  Pairs whose
upper bound does not reach the k-th best lower bound are out; the others are
recomputed on the original components and kept in one heap per query.  The
cells' heaps are merged by a ranked window with a per-task limit.  The result
is exact: the bounds never lose a neighbour.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from revspark.llm.common import byte_batches

#: Components of the candidates and of the queries of one cell, at most on average.
CELL_CANDIDATES = 8192 * 64
CELL_QUERIES = 4096 * 64
TILE = 2048
QUERY_TILE = 256

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """ids and components as doubles, by id."""
    ids = table.column("vec_id").to_numpy()
    col = table.column("v").combine_chunks()
    flat = (pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col).flatten()
    order = np.argsort(ids, kind="stable")
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids[order], m[order]


def _quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the coded vector, norm of what the code leaves out."""
    scale = np.maximum(np.abs(m).max(axis=1) / 127.0, np.finfo(np.float64).tiny)
    codes = np.clip(np.rint(m / scale[:, None]), -127, 127).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.sqrt((coded**2).sum(axis=1)), np.sqrt(((m - coded) ** 2).sum(axis=1))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, added up in component order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def nearest_in_cell(cand_ids, cand, query_ids, queries, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of each query's k best candidates of the cell."""
    c_codes, c_scale, c_norm, c_err = _quantised(cand)
    found: list[tuple[int, int, float]] = []
    for q0 in range(0, len(query_ids), QUERY_TILE):
        qs, q_ids = queries[q0:q0 + QUERY_TILE], query_ids[q0:q0 + QUERY_TILE]
        q_codes, q_scale, q_norm, q_err = _quantised(qs)
        # int8 products and their sums are whole numbers below 2 ** 24 up to 1,040 components; beyond that doubles hold them.
        kind = np.float32 if qs.shape[1] <= 1000 else np.float64
        q_tile = q_codes.astype(kind)
        heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
        worst = np.full(len(q_ids), -np.inf)
        for c0 in range(0, len(cand_ids), TILE):
            part = slice(c0, c0 + TILE)
            near = (q_tile @ c_codes[part].astype(kind).T).astype(np.float64) * q_scale[:, None] * c_scale[None, part]
            err = q_err[:, None] * c_norm[None, part] + q_norm[:, None] * c_err[None, part] + q_err[:, None] * c_err[None, part]
            err += 1e-12 * (q_norm[:, None] + q_err[:, None]) * (c_norm[None, part] + c_err[None, part])
            own = q_ids[:, None] == cand_ids[None, part]
            # where a bound overflows it decides nothing: such pairs are all computed
            low = np.where(own | ~np.isfinite(near) | ~np.isfinite(err), -np.inf, near - err)
            floor = worst
            if low.shape[1] >= k:
                floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, -k])
            qi, ci = np.nonzero(~(near + err < floor[:, None]) & ~own)
            for i, c, s in zip(qi.tolist(), cand_ids[part][ci].tolist(), exact_scores(qs[qi], cand[part][ci]).tolist()):
                if s != s:
                    continue
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (s, -c))
                elif (s, -c) > heap[0]:
                    heapq.heapreplace(heap, (s, -c))
            for i, heap in enumerate(heaps):
                if len(heap) == k:
                    worst[i] = heap[0][0]
        found.extend((int(q), -c, s) for q, heap in zip(q_ids, heaps) for s, c in heap)
    return found


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): vectors with an id, at least one component, no null or non-finite one, and not all zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)))
        .filter(F.exists(v, lambda x: x != 0))
        .withColumn("dim", F.size("v"))
    )


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score of each query's k nearest by inner product.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all rows of the same dimension with another id.  Ties go to the smaller
    id.  Null, zero, empty, partly null or non-finite vectors and rows without
    an id take no part.  Every row is a candidate, so repeated rows come out
    repeatedly; a query that is repeated is asked once, and the rows of an id
    with several vectors are one query whose best candidates count.  A pair
    whose product overflows to no number takes no part.  With fewer than k
    candidates all are returned; a query with none, or an empty table, gives
    no rows.  Other columns are never read."""
    byte_batches(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col)
    is_query = F.col("vec_id") % every == 0
    size = rows.agg(F.coalesce(F.sum("dim"), F.lit(0)), F.coalesce(F.sum(F.when(is_query, F.col("dim"))), F.lit(0))).first()
    g_n, h_n = max(1, -(-size[0] // CELL_CANDIDATES)), max(1, -(-size[1] // CELL_QUERIES))
    cells = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    base = rows.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(g_n)).cast("int").alias("g"), cells(h_n, "h"))
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "dim", cells(g_n, "g"), F.pmod(F.xxhash64("vec_id"), F.lit(h_n)).cast("int").alias("h"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        found = nearest_in_cell(*_matrix(left), *_matrix(right), k)
        cols = list(zip(*found)) if found else [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    by = ["dim", "g", "h"]
    found = base.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(cell, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
