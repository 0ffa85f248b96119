"""Operator 1: exact top-k search by columnar branch and bound.

Vectors lie in blocks in vertical layout, one row of the block's matrix for each
dimension. For a tile of a block of queries and of a block of candidates the
scores are accumulated dimension block by dimension block; after each, the pairs
that cannot reach the query's k-th best any more (partial score plus the product
of the remaining masses of query and candidate) are dropped and the survivors
compacted. The k-th best rises from tile to tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import parts_for

#: Rows and components in a block of candidates or of queries; dimensions accumulated between two compactions.
CANDIDATES = 8192
QUERIES = 8192
CELLS = 1 << 21
STEP = 16
#: Queries and candidates in a tile, heavy candidates that set the first bar, and the share of pairs from which on a list holds them.
TILE_QUERIES = 256
TILE_CANDIDATES = 2048
PROBE = 1024
SPARSE = 1 / 16
_LONG = 2**63 - 1


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(
        F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and components floor(256 * x) as doubles, which hold every such value exactly.

    Vectors null or with null or non-finite components are left out, as are rows
    without an id; of several vectors with one id the smallest counts.
    """
    return _valid(vectors, id_col, vec_col).groupBy("vec_id").agg(F.min("x").alias("x")).select(
        "vec_id", F.transform("x", lambda c: F.lit(256.0) * c).alias("x"))


def _packed(rows: DataFrame, side: str, blocks: int) -> DataFrame:
    """One row for each block: ids and the matrix, dimensions first, shorter vectors filled up with zeros, in the
    smallest of three types that holds its whole numbers."""
    def pack(key, table):
        lists = table.column("x").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        dims = np.diff(lists.offsets.to_numpy())
        values = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
        most = np.abs(values).max(initial=0)
        kind = np.dtype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)
        out = np.zeros((len(dims), int(dims.max())), kind)
        out[np.repeat(np.arange(len(dims)), dims), np.arange(len(values)) - np.repeat(np.cumsum(dims) - dims, dims)] = values
        ids = table.column("vec_id").to_numpy()
        return pa.Table.from_pydict({f"{side}b": pa.array([key[0].as_py()], pa.int32()), "ids": [ids.tobytes()],
                                     "kind": [kind.str], "x": [np.ascontiguousarray(out.T).tobytes()]})

    # the number of partitions is set, because few rows make much work: each block is copied for all others
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition(
        blocks, "block").groupBy("block").applyInArrow(pack, f"{side}b int, ids binary, kind string, x binary")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of one block."""
    r = table.select(["ids", "kind", "x"]).to_pylist()[0]
    ids = np.frombuffer(r["ids"], np.int64)
    return ids, np.frombuffer(r["x"], r["kind"]).reshape(len(r["x"]) // (len(ids) * np.dtype(r["kind"]).itemsize), len(ids))


def _best(rows, ids, scores, k: int):
    """Where the ``k`` best of each row are, by row and rank; ties to smaller ids."""
    order = np.lexsort((ids, ~scores, rows))
    of = rows[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < k]


def _masses(x):
    """For each step, the mass of the dimensions after it."""
    return [np.sqrt((x[d:] ** 2).sum(axis=0)) for d in range(STEP, len(x), STEP)] + [np.zeros(x.shape[1])]


def _reach(q, c, mass_q, mass_c, bar, low, own, k: int):
    """(row, column, score) of the pairs of a tile that reach ``bar`` of their row, or a higher bar from the tile itself.

    ``low`` is the bar less what rounding may take from a bound; ``own`` are the pairs that don't count.
    """
    dims, done, few = len(q), min(STEP, len(q)), SPARSE * q.shape[1] * c.shape[1]
    # partial score and product of masses at once: the masses are one dimension more
    alive = np.vstack([q[:done], mass_q[0]]).T @ np.vstack([c[:done], mass_c[0]]) >= low[:, None]
    alive[own] = False
    if np.count_nonzero(alive) > few:
        score = q[:done].T @ c[:done]
        while done < dims:
            score += q[done:done + STEP].T @ c[done:done + STEP]
            step = done // STEP
            done = min(done + STEP, dims)
            alive = score + np.multiply.outer(mass_q[step], mass_c[step]) >= low[:, None]
            alive[own] = False
            if np.count_nonzero(alive) <= few:
                break
        else:
            score[own] = -np.inf
            if k <= c.shape[1]:
                alive &= score >= np.partition(score, -k, axis=1)[:, -k, None]
        rows, cols = np.divmod(np.flatnonzero(alive), c.shape[1])
        score = score[rows, cols]
    else:
        rows, cols = np.divmod(np.flatnonzero(alive), c.shape[1])
        score = np.einsum("dn,dn->n", q[:done, rows], c[:done, cols])
    while done < dims and len(rows):
        score = score + np.einsum("dn,dn->n", q[done:done + STEP, rows], c[done:done + STEP, cols])
        step = done // STEP
        done = min(done + STEP, dims)
        keep = score + mass_q[step][rows] * mass_c[step][cols] >= low[rows]
        rows, cols, score = rows[keep], cols[keep], score[keep]
    keep = score >= bar[rows]
    return rows[keep], cols[keep], score[keep].astype(np.int64)


def _exact(q, c, limit: float) -> bool:
    """Whether no component and no partial sum of a product comes to ``limit``."""
    total, most = np.abs(q).sum(axis=0).max(initial=0), np.abs(c).max(initial=0)
    return total < limit and most < limit and total * most < limit


def _narrow(q_ids, q, c_ids, c, k: int):
    """(query index, candidate index, score) of each query's best, where doubles hold all partial sums exactly."""
    found = [[np.zeros(0, np.int64)] * 3]
    if not (len(q_ids) and len(c_ids)):
        return found[0]
    order = np.lexsort((c_ids, -(c ** 2).sum(axis=0)))  # heavy candidates first: they set the bar
    c, c_ids = c[:, order], c_ids[order]
    kind, least = (np.float32, 1e-5) if _exact(q, c, 2**24) else (np.float64, 1e-12)
    slack = least * np.sqrt((q ** 2).sum(axis=0)) * np.sqrt((c ** 2).sum(axis=0).max())  # more than rounding takes
    mass_q, mass_c = ([m.astype(kind) for m in _masses(x)] for x in (q, c))
    q, c = q.astype(kind), c.astype(kind)
    by_id = np.argsort(c_ids)
    place = by_id[np.minimum(np.searchsorted(c_ids[by_id], q_ids), len(c_ids) - 1)]
    place = np.where(c_ids[place] == q_ids, place, -1)
    edges = [0, *range(min(PROBE, len(c_ids)), len(c_ids), TILE_CANDIDATES), len(c_ids)]
    for a in range(0, len(q_ids), TILE_QUERIES):
        tile = slice(a, a + TILE_QUERIES)
        n = len(q_ids[tile])
        best, bar, last = found[0], np.full(n, -np.inf), np.full(n, _LONG)
        for b, e in zip(edges, edges[1:], strict=False):
            own = np.flatnonzero((place[tile] >= b) & (place[tile] < e))
            rows, cols, scores = _reach(
                q[:, tile], c[:, b:e], [m[tile] for m in mass_q], [m[b:e] for m in mass_c], bar.astype(kind),
                (bar - slack[tile]).astype(kind), (own, place[tile][own] - b), k)
            new = (scores > bar[rows]) | (c_ids[b + cols] < last[rows])
            if not new.any():
                continue
            rows, cols, scores = (np.r_[x, y[new]] for x, y in zip(best, (rows, b + cols, scores), strict=True))
            top = _best(rows, c_ids[cols], scores, k)
            best = rows[top], cols[top], scores[top]
            full = np.flatnonzero(np.bincount(best[0], minlength=n) >= max(k, 1))
            end = np.searchsorted(best[0], full, "right") - 1
            bar[full], last[full] = best[2][end], c_ids[best[1][end]]
        found.append((best[0] + a, order[best[1]], best[2]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _wide(q_ids, q, c_ids, c, k: int):
    """The same in Python integers; scores stop at the ends of long."""
    found, rows = [], [[int(v) for v in col] for col in c.T]
    for i, col in enumerate(q.T):
        a = [int(v) for v in col]
        scores = [max(-_LONG - 1, min(_LONG, sum(x * y for x, y in zip(a, r, strict=True)))) for r in rows]
        order = sorted((j for j in range(len(rows)) if c_ids[j] != q_ids[i]), key=lambda j: (-scores[j], c_ids[j]))
        found += [(i, j, scores[j]) for j in order[:k]]
    return [np.array(x, np.int64) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def best_pairs(q_ids, q, c_ids, c, k: int):
    """Query indexes, candidate indexes and scores of each query's k best candidates in one block, by query and rank;
    ties to smaller ids.

    ``q`` and ``c`` hold whole numbers, dimensions first; no id comes twice on one side. Where no partial sum can
    leave the whole numbers that doubles hold exactly, the search runs in floating point; the queries and candidates
    beyond are scored in Python integers.
    """
    dims = min(len(q), len(c))  # beyond it one side has only zeros
    q, c = q[:dims].astype(np.float64), c[:dims].astype(np.float64)
    if _exact(q, c, 2**53):
        return _narrow(q_ids, q, c_ids, c, k)
    tall, large, found = np.abs(q).sum(axis=0) >= 2**26, np.abs(c).max(axis=0, initial=0) >= 2**26, []
    for search, i, j in ((_narrow, ~tall, ~large), (_wide, tall, large | True), (_wide, ~tall, large)):
        i, j = np.flatnonzero(i), np.flatnonzero(j)
        rows, cols, scores = search(q_ids[i], q[:, i], c_ids[j], c[:, j], k)
        found.append((i[rows], j[cols], scores))
    rows, cols, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    top = _best(rows, c_ids[cols], scores, k)
    return rows[top], cols[top], scores[top]


def block_top(q_ids, q, c_ids, c, k: int):
    """(query index, candidate index, score) one by one, as ``best_pairs`` finds them."""
    yield from zip(*(x.tolist() for x in best_pairs(q_ids, q, c_ids, c, k)), strict=True)


def top_k(vectors: DataFrame, k: int = 5, modulo: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``modulo`` the ``k`` other rows with the
    highest integer inner product, ties to the smaller id; all of them where there are fewer.

    Every pair of a query block and a candidate block is one unit of work, dealt
    out by the pair; only k rows a query leave it, so neither copies of one
    vector nor ties gather anywhere. Block numbers grow with the rows and their
    length. The two blocks of a unit meet in a cogroup, which is always shuffled:
    the planner's size of a packed and exploded side is that of the rows below
    it, so it would broadcast a join of many times its limit through the driver.

    Components become floor(256 * x). Null vectors, null or non-finite components
    and null ids take no part; of rows repeated with one id the smallest vector
    counts once; a missing dimension counts as 0, so an empty vector scores 0.
    Scores beyond long stop at its ends. An empty table gives no rows.
    """
    rows = whole_vectors(vectors, id_col, vec_col)
    is_asked = F.col("vec_id") % modulo == 0
    asked = rows.where(is_asked)
    n = _valid(vectors, id_col, vec_col).groupBy("vec_id").agg(F.max(F.size("x")).alias("d")).agg(
        F.count(F.lit(1)), F.count(F.when(is_asked, 1)), F.sum("d"), F.sum(F.when(is_asked, F.col("d")))).first()
    c_blocks = max(parts_for(n[0], CANDIDATES), parts_for(n[2], CELLS))
    q_blocks = max(parts_for(n[1], QUERIES), parts_for(n[3], CELLS))
    parts = 2 * max(c_blocks, q_blocks)  # set, because units of few bytes take long

    def units(side, blocks, other, others):
        return _packed(side, blocks[0], blocks[1]).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(parts, "qb", "cb").groupBy("qb", "cb")

    def search(left, right):
        got = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            (q_ids, q), (c_ids, c) = _unpacked(left), _unpacked(right)
            i, j, score = best_pairs(q_ids, q, c_ids, c, k)
            got = [q_ids[i], c_ids[j], score]
        return pa.Table.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])

    found = units(asked, ("q", q_blocks), "cb", c_blocks).cogroup(units(rows, ("c", c_blocks), "qb", q_blocks)).applyInArrow(
        search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH fine AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
