"""Exact cosine top-k over a vector column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.answers import ranked
from skein.session import cut

# Elements of a block of queries and of a block of vectors, on average; a task holds one of each (4 and 32 MB as doubles).
QUERY_BLOCK = 512 * 1024
VECTOR_BLOCK = 4 * 1024 * 1024
# Scores of one matrix product: this many queries against this many vectors.
_TILE = 512, 4_096
# Scores closer than this are ties, so that rounding noise of the matrix product cannot order rows.
SCORE_DIGITS = 12


def _unit(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of length one as rows; not a number where a vector has no direction."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * size:
        raise ValueError(f"every vector must have {size} elements")
    rows = flat.reshape(len(column), size)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.full_like(rows, np.nan), where=norms > 0)


def _best(scores: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``limit`` columns of every row by falling score, then by id; scores that are not numbers come last."""
    order = np.lexsort((ids, -scores), axis=1)[:, :limit]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _candidates(scores: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``limit`` of every row, from scores against ``ids`` in rising order; a tie at the border goes to smaller ids."""
    if scores.shape[1] > limit:
        border = -np.partition(-scores, limit - 1, axis=1)[:, limit - 1 : limit]
        above, level = scores > border, scores == border
        room = limit - above.sum(axis=1, keepdims=True)
        taken = above | level & (np.cumsum(level, axis=1) <= room)
        place = np.nonzero(taken)[1].reshape(len(scores), limit)
        return np.take_along_axis(scores, place, 1), ids[place]
    return scores, np.broadcast_to(ids, scores.shape)


def _block_product(limit: int):
    """Task body: the best ``limit`` vectors of a block for each query of a block, tile by tile."""

    def score(asked: pa.Table, vectors: pa.Table) -> pa.Table:
        answers: list[pa.Table] = []
        if asked.num_rows and vectors.num_rows:
            first = asked.column("embedding").chunk(0)
            size = len(first[0].as_py())
            queries, rows = _unit(asked.column("embedding"), size), _unit(vectors.column("embedding"), size)
            ids = vectors.column("vec_id").to_numpy().astype(np.int64)
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            numbers = asked.column("query").to_numpy()
            for at in range(0, len(queries), _TILE[0]):
                part = queries[at : at + _TILE[0]]
                best, best_ids = np.full((len(part), 0), -np.inf), np.zeros((len(part), 0), np.int64)
                for start in range(0, len(rows), _TILE[1]):
                    scores = np.round(part @ rows[start : start + _TILE[1]].T, SCORE_DIGITS)
                    scores[np.isnan(scores)] = -np.inf  # a zero vector has no direction: never ranked
                    more, more_ids = _candidates(scores, ids[start : start + _TILE[1]], limit)
                    best, best_ids = _best(np.concatenate([best, more], axis=1), np.concatenate([best_ids, more_ids], axis=1), limit)
                query, place = np.nonzero(np.isfinite(best))
                columns = [numbers[at : at + _TILE[0]][query], best_ids[query, place], best[query, place]]
                answers.append(pa.table([pa.array(c) for c in columns], names=["query", "vec_id", "score"]))
        none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query", "vec_id", "score"])
        return pa.concat_tables([none, *answers])

    return score


def search_semantic(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` vectors (``vec_id, embedding``) nearest to every query (``request_id, embedding``) by cosine.

    Answers ``request_id, vec_id, score, rank``; equal scores rank by ``vec_id``. Every row of ``queries`` is a query of its own,
    also where ids repeat. Null vectors take no part and zero vectors are never ranked; vectors of another length end the job.

    Both tables are dealt into blocks by hash, their numbers from their elements. Each pair of blocks meets in one task, which gives out at most ``limit`` rows per
    query; so every vector travels once per block of queries, and no query passes through the driver.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    base = vectors.filter(F.isnotnull("embedding") & F.isnotnull("vec_id")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.select(F.col("request_id").cast("string").alias("request_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = cut(asked.filter(F.isnotnull("embedding")).withColumn("query", F.monotonically_increasing_id()), "queries")
    if not limit:
        return vectors.sparkSession.createDataFrame([], "request_id string, vec_id long, score double, rank int")

    def in_blocks(df: DataFrame, block: int) -> int:
        return -(-(df.agg(F.sum(F.size("embedding"))).first()[0] or 0) // block) or 1

    groups, blocks = in_blocks(asked, QUERY_BLOCK), in_blocks(base, VECTOR_BLOCK)

    def dealt(df: DataFrame, key: str, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        """Each row in its own block, once for every block of the other table."""
        return df.select("*", F.pmod(F.xxhash64(key), F.lit(own_blocks)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other))

    left = dealt(asked.select("query", "embedding"), "query", "group", groups, "block", blocks)
    right = dealt(base, "vec_id", "block", blocks, "group", groups)
    pairs = left.groupBy("group", "block").cogroup(right.groupBy("group", "block"))
    scored = pairs.applyInArrow(_block_product(limit), "query long, vec_id long, score double")
    scored = ranked(scored, ["query"], [F.desc("score"), F.asc("vec_id")], limit)
    return scored.join(asked.select("query", "request_id"), "query").select("request_id", "vec_id", "score", "rank")
