"""Nearest neighbours by cosine, with one-bit codes of randomly rotated vectors in front of the exact measure.

Every vector is scaled to length one, padded to ``width`` and rotated: three rounds of random signs and a Hadamard transform. Its code is one sign bit per
rotated component; the code read as a unit vector c has an inner product a = <c, v> with the vector, which is kept as its correction. For a rotated query q,
<c, q> / a estimates <v, q> without bias, and its error is that of a random direction: it stays below ``spread * sqrt((1 - a * a) / (a * a * (width - 1)))``
but for the chance that a normal value exceeds ``spread``. Vectors whose estimate plus that bound reaches the k-th best cosine found so far are reranked with the
vectors themselves. More bits than components make the bound as narrow as wished: it falls with the root of ``width``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.answers import ranked
from skein.llm.common import runs
from skein.llm.vectors import first_of_ids, matrix, met_in_buckets, number_of_buckets, padded, usable, vector_column
from skein.session import cut

SEED = 42
# Bits per component, rounded up to a power of two in all, and the width of the error bound in standard deviations.
BITS = 4
SPREAD = 4.0
# Vectors and queries that are estimated in one matrix product, and pairs that are reranked together.
_VECTORS, _QUERIES, _PAIRS = 4096, 256, 50_000


def code_width(dimensions: int, bits: int = BITS) -> int:
    """Bits of a code: a power of two with at least ``bits`` per component, whole bytes."""
    return max(64, 1 << max(0, bits * dimensions - 1).bit_length())


@functools.lru_cache(maxsize=2)
def rotation(dimensions: int, width: int, seed: int = SEED) -> np.ndarray:
    """Rows are where the unit vectors of the first ``dimensions`` axes go; an axis goes to the same place whatever their number is."""
    x = np.eye(dimensions, width)
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], width)
        step = 1
        while step < width:
            pairs = x.reshape(dimensions, -1, 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(dimensions, width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def unit(rows: np.ndarray) -> np.ndarray:
    # the largest component first, so that no square leaves the range of a double
    rows = rows / np.abs(rows).max(axis=1, initial=0, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def encode(rows: np.ndarray, width: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated directions, and the inner product of each code with its direction."""
    rotated = unit(rows) @ rotation(rows.shape[1], width, seed)
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(width)


def one_bit_index(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, seed: int = SEED
) -> DataFrame:
    """``id, vector, code binary, correction double`` of every vector that can be searched; the width of all codes follows the longest vector.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, are left out. Other columns are ignored.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), vector_column(rows, vector_col).alias("vector"))
    base = base.filter(F.isnotnull("id") & usable(F.col("vector"))).filter(F.exists("vector", lambda x: x != 0))
    dimensions = base.agg(F.max(F.size("vector"))).first()[0] or 1
    width = code_width(dimensions, bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, corrections = encode(matrix(batch.column(1), dimensions), width, seed)
            flat = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.record_batch([*batch.columns, flat, pa.array(corrections)], ["id", "vector", "code", "correction"])

    kind = base.schema["vector"].dataType.simpleString()
    return base.mapInArrow(run, f"id long, vector {kind}, code binary, correction double")


def _sums(products: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` and ``b`` in doubles, summed in the order of the components."""
    dots = _sums(a * b)
    lengths = np.sqrt(_sums(a * a)) * np.sqrt(_sums(b * b))
    return dots / lengths


class Nearest:
    """The best ``most`` of every query so far."""

    def __init__(self, queries: int, most: int) -> None:
        self.most = most
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        starts = runs(query)
        place = np.arange(len(query)) - np.repeat(starts[:-1], np.diff(starts))
        self.query, self.score, self.id = (x[place < self.most] for x in (query, score, ids))
        last = place == self.most - 1
        self.least[query[last]] = score[last]


def _search(k: int, seed: int, spread: float):
    def answer(table: pa.Table):
        ids = table.column("id").to_numpy()
        if len(np.unique(ids)) < len(ids):
            keep = pa.array(first_of_ids(ids, table.column("vector").to_pylist()))
            table, ids = table.take(keep), ids[keep]
        vectors = matrix(table.column("vector"))
        codes = np.array([np.frombuffer(c, np.uint8) for c in table.column("code").to_pylist()])
        corrections = table.column("correction").to_numpy()
        width = 8 * codes.shape[1] if len(codes) else 0

        def exact(asked: np.ndarray, query: np.ndarray, at: np.ndarray) -> np.ndarray:
            parts = [
                cosines(asked[query[i : i + _PAIRS]], padded(vectors[at[i : i + _PAIRS]], asked.shape[1])) for i in range(0, len(query), _PAIRS)
            ]
            return np.concatenate(parts) if parts else np.zeros(0)

        def some(asked: np.ndarray, own: np.ndarray) -> Nearest:
            best = Nearest(len(asked), k)
            rotated = (unit(asked) @ rotation(asked.shape[1], width, seed)).astype(np.float32)
            for first in range(0, len(ids), _VECTORS):
                at = slice(first, first + _VECTORS)
                signs = np.unpackbits(codes[at], axis=1).astype(np.float32) * 2 - 1
                scale = (1 / (np.sqrt(width) * corrections[at])).astype(np.float32)
                estimates = (rotated @ signs.T) * scale
                estimates[own[:, None] == ids[at][None, :]] = -np.inf
                error = spread * np.sqrt(np.maximum(0, 1 / corrections[at] ** 2 - 1) / (width - 1))
                # the best by estimate first: their cosines raise the bar for all others
                most = min(k, estimates.shape[1])
                top = np.argpartition(-estimates, most - 1, axis=1)[:, :most]
                query, column = np.repeat(np.arange(len(asked)), most), top.ravel()
                seen = np.isfinite(estimates[query, column])
                query, column = query[seen], column[seen]
                best.add(query, exact(asked, query, column + first), ids[column + first])
                estimates[query, column] = -np.inf
                query, column = np.nonzero(estimates + error.astype(np.float32) >= best.least[:, None] - 1e-6)
                seen = np.isfinite(estimates[query, column])
                query, column = query[seen], column[seen]
                for i in range(0, len(query), 20 * _PAIRS):
                    part = slice(i, i + 20 * _PAIRS)
                    best.add(query[part], exact(asked, query[part], column[part] + first), ids[column[part] + first])
            return best

        def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if not len(ids):
                return
            asked, own = padded(matrix(batch.column("vector")), vectors.shape[1]), batch.column("id").to_numpy()
            for first in range(0, len(own), _QUERIES):
                mine = own[first : first + _QUERIES]
                best = some(asked[first : first + _QUERIES], mine)
                columns = [pa.array(mine[best.query]), pa.array(best.id), pa.array(best.score)]
                yield pa.record_batch(columns, ["query_id", "vec_id", "score"])

        return search

    return answer


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, spread: float = SPREAD, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of ``index`` with the largest cosine to each of ``queries(id, vector)``.

    ``index`` is that of ``one_bit_index`` with the same ``seed``. Scores are cosines of the vectors themselves in doubles; ties go to the smaller id; a row of the index
    with the query's own id is not its neighbour. Shorter vectors go on with zeros. Of rows that repeat an id, the smallest vector counts, in both tables.
    Queries without a usable vector, and empty tables, give no rows.
    """
    asked = queries.filter(F.isnotnull("id") & usable(F.col("vector"))).filter(F.exists("vector", lambda x: x != 0))
    asked = cut(asked.groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    found = met_in_buckets(index, asked, number_of_buckets(index, "vector"), _search(k, seed, spread), "query_id long, vec_id long, score double")
    best = ranked(found, ["query_id"], [F.desc("score"), "vec_id"], k)
    return best.select("query_id", "rank", "vec_id", "score")


def nearest_rows(
    rows: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", spread: float = SPREAD
) -> DataFrame:
    """``nearest`` of the rows where ``asks`` holds among all ``rows``."""
    index = cut(one_bit_index(rows, id_col, vector_col), "one-bit-index")
    asked = rows.filter(asks).select(F.col(id_col).cast("long").alias("id"), vector_column(rows, vector_col).alias("vector"))
    return nearest(index, asked, k, spread)
