"""Exact top-k search by inner product: columnar branch-and-bound over integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geozone.llm.common import shuffle_partitions
from geozone.session import written

SCALE = 256
# Rows of a tile: candidates that one task holds, and queries that meet them there.
CANDIDATES = 32_768
QUERIES = 8_192
# Dimensions added at a time, and candidates scored before the bounds are drawn tighter.
DIMENSIONS = 16
BLOCK = 4_096
# Below this, sums of products of whole numbers are exact in double precision.
EXACT = float(1 << 53)


def usable(vector: str = "embedding") -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, body) for every usable row, components floor(scale * x) as little-endian doubles."""

    def run(batches):
        for batch in batches:
            found = batch.column("embedding")
            size = np.array([len(x) for x in found], np.int32)
            flat = np.floor(scale * found.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype("<f8")
            cuts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            body = [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch(
                [batch.column("vec_id"), pa.array(size), pa.array(body, pa.binary())], names=["vec_id", "dim", "body"]
            )

    chosen = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>"))
    chosen = chosen.filter(F.col("vec_id").isNotNull() & usable())
    return chosen.mapInArrow(run, "vec_id bigint, dim int, body binary")


def search(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best k of `rows` by inner product, ties to smaller ids, rows with the query's id left out.

    Candidates are laid out by dimension, the longest first. A query adds up its products block of dimensions by block;
    after each, candidates whose sum and remaining mass (product of the lengths of what is left of both) cannot reach the
    k-th best score so far are dropped and the rest are moved together.
    """
    order = np.argsort(-np.einsum("ij,ij->i", rows, rows), kind="stable")
    rows, ids = rows[order], ids[order]
    columns = np.ascontiguousarray(rows.T)
    starts = list(range(0, rows.shape[1], DIMENSIONS))
    rest = lambda m: np.sqrt(np.cumsum((m**2)[:, ::-1], axis=1)[:, ::-1][:, starts[1:]])
    rows_rest, queries_rest = np.ascontiguousarray(rest(rows).T), rest(queries)
    if np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(1, rows.shape[1]) >= EXACT:
        yield from _search_large(queries, query_ids, rows, ids, k)
        return
    for q, query_id in enumerate(query_ids):
        query, worst = queries[q], -np.inf
        best_score, best_id = np.zeros(0), np.zeros(0, np.int64)
        for at in range(0, len(ids), BLOCK):
            alive = np.arange(at, min(at + BLOCK, len(ids)))
            alive = alive[ids[alive] != query_id]
            score = np.zeros(len(alive))
            for step, start in enumerate(starts):
                part = slice(start, start + DIMENSIONS)
                score += query[part] @ columns[part, alive]
                if step < len(starts) - 1:
                    bound = score + queries_rest[q, step] * rows_rest[step, alive]
                    keep = bound + 0.5 + 1e-9 * np.abs(bound) >= worst
                    if not keep.all():
                        alive, score = alive[keep], score[keep]
            best_score, best_id = np.append(best_score, score), np.append(best_id, ids[alive])
            top = np.lexsort((best_id, -best_score))[:k]
            best_score, best_id = best_score[top], best_id[top]
            worst = best_score[-1] if len(top) == k else -np.inf
        yield query_id, best_id, best_score.astype(np.int64)


def _search_large(queries, query_ids, rows, ids, k):
    """As `search`, in whole numbers of any size, for components too large for exact doubles; scores end at bigint's range."""
    whole = [[int(x) for x in row] for row in rows]
    for query, query_id in zip(queries, query_ids, strict=True):
        own = [int(x) for x in query]
        scored = [(-sum(a * b for a, b in zip(own, row, strict=True)), int(i)) for row, i in zip(whole, ids, strict=True) if i != query_id]
        top = sorted(scored)[:k]
        clipped = [min(max(-s, -(1 << 63)), (1 << 63) - 1) for s, _ in top]
        yield query_id, np.array([i for _, i in top], np.int64), np.array(clipped, np.int64)


def _tile(k: int):
    def run(_key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for dim in set(queries.column("dim").to_pylist()):
            pick = lambda t: t.filter(pa.compute.equal(t.column("dim"), dim))  # noqa: E731, B023
            one, other = pick(queries), pick(rows)
            matrix = lambda t: np.frombuffer(b"".join(t.column("body").to_pylist()), "<f8").reshape(t.num_rows, dim)  # noqa: E731, B023
            if other.num_rows:
                ids = one.column("vec_id").to_numpy(), other.column("vec_id").to_numpy()
                out += [(q, i, s) for q, i, s in search(matrix(one), ids[0], matrix(other), ids[1], k) if len(i)]
        cat = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
        query = cat(np.full(len(i), q, np.int64) for q, i, _ in out)
        return pa.table({"query_id": query, "vec_id": cat(i for _, i, _ in out), "score": cat(s for _, _, s in out)})

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for `rows` (vec_id, embedding) where `is_query` holds of vec_id; exact.

    Work is dealt in tiles of at most about CANDIDATES x QUERIES rows, so a task's memory is bounded; a tile gives its best k
    per query, and the best k of those follow. Every query meets every other row in exactly one tile.

    Left out, as query and as candidate: null ids, null vectors, vectors with a null or non-finite component. Rows with one
    id are all candidates; where they are queries, the best k of all their pairs count. Vectors of another length than the
    query's are no candidates. Very long vectors only take more memory in their tile. Queries without candidates, and empty tables,
    give no rows. Where components are so large that doubles do not hold every sum exactly, a tile is scored in whole
    numbers of any size, without bounds, and scores end at bigint's range.
    """
    # Tiles are dealt by a number of the row, so that many rows with one id are dealt too.
    numbered = vectors(rows, scale).withColumn("number", F.monotonically_increasing_id())
    known = written(numbered, "vectors")
    n, n_queries = known.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    across = max(1, -(-n // CANDIDATES), min(n // 1024, shuffle_partitions(rows.sparkSession)))
    down = max(1, -(-n_queries // QUERIES))
    place = lambda parts: F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = known.withColumn("col", place(across)).withColumn("row", every(down))
    queries = known.filter(is_query).withColumn("row", place(down)).withColumn("col", every(across))
    tiles = candidates.groupBy("col", "row").cogroup(queries.groupBy("col", "row"))
    found = tiles.applyInArrow(_tile(k), "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
