"""Vector columns as matrices, and queries that meet all vectors bucket by bucket.

Vectors are dealt into buckets by their id, so a bucket holds a bounded share of the bytes whatever their values are; every query visits every
bucket. A task reads the vectors of a bucket first, builds what it searches with, and then answers the queries as they stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import runs

# Bytes of the vectors of one bucket, at 8 bytes a component, and the fewest vectors a bucket is made for.
BUCKET_BYTES = 64 * 1024 * 1024
LEAST_ROWS = 1024


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.isnotnull(vector) & ~F.coalesce(bad, F.lit(False))


def vector_column(rows: DataFrame, name: str) -> Column:
    """The column as floats or doubles; other numbers become doubles."""
    kind = rows.schema[name].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(name) if single else F.col(name).cast("array<double>")


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of doubles; vectors shorter than the longest, or than ``width``, go on with zeros, longer ones are cut to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    longest = int(sizes.max(initial=0))
    if width is None:
        width = longest
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), max(width, longest)))
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out[:, :width]


def padded(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def number_of_buckets(vectors: DataFrame, vector: str) -> int:
    """So many that the vectors of one fit in a task, and that there is work for all tasks of a shuffle."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(vector).cast("long")).alias("parts")).first()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-8 * (size["parts"] or 0) // BUCKET_BYTES), min(tasks, size["n"] // LEAST_ROWS))


def met_in_buckets(vectors: DataFrame, queries: DataFrame, buckets: int, answer: Callable[[pa.Table], Callable], out: str) -> DataFrame:
    """All answers of ``queries`` in every bucket of ``vectors``; both have an ``id``.

    ``answer(table)`` gets the vectors of a bucket and gives a function from a batch of queries to batches of ``out``.
    """
    dealt = vectors.withColumns({"bucket": F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"), "asks": F.lit(False)})
    visits = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    asked = queries.select("*", visits.alias("bucket"), F.lit(True).alias("asks"))
    both = dealt.unionByName(asked, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", "asks")
    return both.mapInArrow(_in_buckets(answer), out)


def _in_buckets(answer: Callable[[pa.Table], Callable]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, search = None, [], None
        for batch in batches:
            numbers = batch.column("bucket").to_numpy(zero_copy_only=False)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            starts = runs(numbers, asks)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                part = batch.slice(a, b - a)
                if numbers[a] != bucket:
                    bucket, held, search = numbers[a], [], None
                if not asks[a]:
                    held.append(part)
                else:
                    if search is None:
                        search = answer(pa.Table.from_batches(held, part.schema))
                        held = []
                    yield from search(part)

    return run


def first_of_ids(ids: np.ndarray, *keys: list) -> np.ndarray:
    """Places of one row for every id: of rows that repeat an id, the one with the smallest ``keys``."""
    order = np.argsort(ids, kind="stable")
    starts = runs(ids[order])
    if len(starts) - 1 == len(ids):
        return np.arange(len(ids))
    best = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        best.append(min(order[a:b].tolist(), key=lambda i: [k[i] for k in keys]) if b - a > 1 else int(order[a]))
    return np.array(best, np.int64)
