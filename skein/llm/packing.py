"""Best-fit packing of token sequences into bins of a fixed size.

Lengths and gaps are whole numbers up to the bin size, and documents of one length, like bins of one gap, can stand for each
other. So the range-sorted documents and gaps are kept as runs of equal size, counted by one distributed aggregation. From the
longest run down, bulk-synchronous rounds match a run of documents to its successors, the smallest gaps that hold them:
documents that want the same gaps get them by rank, all gaps are updated at once, and the documents left go into the
next round. The result is that of best fit decreasing. The table of matches depends on the bin size, not on the
number of documents, so it is small enough to broadcast. What grows with the data, the rank of every document within
its length and the place which that rank has in the matches, is worked out in distributed tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import fresh
from skein.session import cut

# Rows that one window group ranks, about.
ROWS_PER_GROUP = 50_000

# (length, rank of the first document, documents, first bin, offset in the bins)
Match = tuple[int, int, int, int, int]


def sweep(length: int, left: int, gaps: dict[int, list[tuple[int, int]]], size: int) -> Iterator[tuple[int, int, int]]:
    """One round for ``left`` documents of one length: ``(first bin, bins, offset)`` of every run of bins that gets one each.

    The documents ask for their successors, the smallest gaps that hold them, and take them by rank. A bin gets one document a
    round. The gaps are updated when the sweep is over.
    """
    after: list[tuple[int, int, int]] = []
    for gap in sorted(g for g in gaps if g >= length):
        while left and gaps[gap]:
            first, n = gaps[gap].pop()
            take = min(n, left)
            if take < n:
                gaps[gap].append((first + take, n - take))
            left -= take
            after.append((gap - length, first, take))
            yield first, take, size - gap
        if not gaps[gap]:
            del gaps[gap]
        if not left:
            break
    for gap, first, n in after:
        if gap:
            gaps[gap] = _joined([*gaps.get(gap, []), (first, n)])


def _joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of bins with adjacent ones made one."""
    joined: list[tuple[int, int]] = []
    for first, n in sorted(found):
        if joined and sum(joined[-1]) == first:
            first, n = joined[-1][0], joined.pop()[1] + n
        joined.append((first, n))
    return joined


def match_rounds(counts: np.ndarray, size: int) -> tuple[list[Match], int]:
    """All matches for ``counts[length]`` documents of every length, and the number of bins.

    The longest documents go first. When no gap holds what is left of a run, as many bins are added as hold it when each is
    filled with documents of that length.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    matches: list[Match] = []
    bins = 0
    for length in range(size, 0, -1):
        placed, total = 0, int(counts[length])
        while placed < total:
            before = placed
            for first, n, offset in sweep(length, total - placed, gaps, size):
                matches.append((length, placed, n, first, offset))
                placed += n
            if placed == before:
                more = -(-(total - placed) // (size // length))
                gaps[size] = [(bins, more)]
                bins += more
    return matches, bins


def cut_lengths(total: str, size: int):
    """Column of ``(start, length)`` pieces for a column of token counts: all of ``size`` tokens, but the first may be shorter."""
    n, first = F.col(total), F.when(F.col(total) % size == 0, F.lit(size)).otherwise(F.col(total) % size)
    places = F.sequence(F.lit(0), F.ceil((n - first) / size).cast("int"))
    pieces = F.transform(
        places,
        lambda k: F.struct(
            k.alias("piece"),
            F.when(k == 0, F.lit(0)).otherwise(first + (k - 1) * size).cast("long").alias("start"),
            F.when(k == 0, first).otherwise(F.lit(size)).cast("long").alias("length"),
        ),
    )
    return F.when(n > 0, pieces).otherwise(F.array())


def best_fit(pieces: DataFrame, size: int, key: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (longs), which replace columns of these names; every length must be 1 to ``size``.

    Rows with one key each get a place of their own; which of two pieces of one length goes where follows the key. Null and zero lengths
    take no room: both columns are null there. Longer pieces are an error. An empty table gives no rows. ``pieces`` is read more
    than once, so it should be a written table.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop(*{"sequence_id", "offset"} - {*key, length})
    kept = pieces.columns
    salted_by, place_in, n_before = (fresh(kept, name) for name in ("_salt", "_rank", "_before"))
    rows = pieces.filter(F.col(length) > 0)
    lengths = rows.groupBy(F.col(length).alias("size")).count().collect()  # at most ``size`` rows
    if any(r["size"] > size for r in lengths):
        raise ValueError(f"a piece is longer than {size}")
    counts = np.zeros(size + 1, np.int64)
    for r in lengths:
        counts[r["size"]] = r["count"]
    matches, _ = match_rounds(counts, size)
    plan = np.array(matches or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])

    salts = int(max(16, counts.sum() // ROWS_PER_GROUP))
    salt = F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int")
    salted = rows.withColumn(salted_by, salt)
    sizes = salted.groupBy(length, salted_by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(length).orderBy(salted_by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.select(length, salted_by, F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias(n_before)), "ranks")
    rank = F.row_number().over(Window.partitionBy(length, salted_by).orderBy(*key)) - 1
    ranked = salted.withColumn(place_in, rank).join(sizes, [length, salted_by])
    ranked = ranked.select(*kept, (F.col(n_before) + F.col(place_in)).alias(place_in))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = kept.index(length)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        table = plan.value
        starts = table[:, 0] * (1 << 44) + table[:, 1]  # sorted: length, then rank
        for batch in batches:
            sizes, ranks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, len(kept)))
            hit = table[np.searchsorted(starts, sizes * (1 << 44) + ranks, "right") - 1]
            bins, offsets = hit[:, 3] + ranks - hit[:, 1], hit[:, 4]
            columns = [c.cast(f.type) for c, f in zip(batch.columns[: len(kept)], target)]
            yield pa.record_batch([*columns, pa.array(bins), pa.array(offsets)], schema=target)

    placed = ranked.mapInArrow(place, out)
    nothing = pieces.filter(F.coalesce(F.col(length), F.lit(0)) <= 0)
    return placed.unionByName(nothing.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}))
