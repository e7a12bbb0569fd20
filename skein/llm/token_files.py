"""Token ids in files of bit-packed blocks, in ascending order of the document id.

A file set is two Parquet tables, so Spark's committer makes the writes safe against lost tasks and any store will do:

* ``blocks``: one row per block of whole documents; ``payload`` holds their ids at the fixed width that the vocabulary
  needs, lowest bit first; ``doc_ids`` and ``lengths`` say whose they are; ``block_start`` is the place of the first id within the shard,
* ``shards``: one row per shard with ``shard_start``, the number of ids in all shards before it.

The place of any id is a sum of three offsets, and its bits lie at ``place * width``, so one document is read without the
rest of its block, and a block is unpacked by one numpy expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import id_and_text, id_type
from skein.llm.encoding import END_ID, word_table

IDS_PER_BLOCK = 1 << 16


def id_width(vocabulary_size: int) -> int:
    """Bits that the largest id of the vocabulary needs; at least one."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` at ``width`` bits each, lowest bit first, padded to a whole byte."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the id ``first`` on, without unpacking what lies before or after them."""
    if width == 16:
        return np.frombuffer(payload, "<u2", count, 2 * first).astype(np.uint32)
    start = first * width
    raw = np.frombuffer(payload, np.uint8, offset=start // 8)[: (start % 8 + count * width + 7) // 8]
    bits = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + count * width]
    return bits.reshape(count, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def _block_schema(ids: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("block_start", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("first_doc", ids),
            T.StructField("last_doc", ids),
            T.StructField("doc_ids", T.ArrayType(ids)),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("payload", T.BinaryType()),
        ]
    )


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, vocabulary_size: int, id_col: str = "doc_id", text_col: str = "text",
    ids_per_block: int = IDS_PER_BLOCK,
) -> None:
    """Encode every whole text, add ``END_ID``, and write the ids of all documents below ``path`` in ascending id order.

    Documents are range-partitioned by id before they are encoded, so each task writes one shard. Null ids come first; rows
    with one id are ordered by their texts. A null text is empty: its only id is ``END_ID``. An empty table gives empty files.
    """
    kind = id_type(docs, id_col)
    out = _block_schema(kind)
    width = id_width(vocabulary_size)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        shard, start = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        held: list[tuple[object, bytes]] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            row = [shard, start, len(ids), width, held[0][0], held[-1][0], [d for d, _ in held], [len(x) // 4 for _, x in held], pack_bits(ids, width)]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, target)], schema=target)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, coded in zip(doc_ids, word_table(vocabulary).ids(texts), strict=True):
                held.append((doc, coded + end))
                size += len(coded) // 4 + 1
                if size >= ids_per_block:
                    yield block()
                    start, held, size = start + size, [], 0
        if held:
            yield block()

    rows = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(blocks, out).write.parquet(f"{path}/blocks")
    spark = docs.sparkSession
    # one row per shard, so the running sum is over as many rows as there were tasks
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id, start, ids`` of every document in the files, or only of those whose id is in ``wanted``'s first column.

    ``start`` is the number of ids of all documents before it; ``ids`` are little-endian unsigned 32-bit numbers in a binary.
    """
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/shards").select("shard", "shard_start"), "shard")
    kind = blocks.schema["first_doc"].dataType
    blocks = blocks.select(
        "width", "payload", (F.col("shard_start") + F.col("block_start")).alias("start"), "doc_ids", "lengths",
        F.sequence(F.lit(0), F.size("doc_ids") - 1).alias("places"),
    )
    if wanted is not None:
        asked = wanted.select(F.col(wanted.columns[0]).alias("asked")).distinct()
        hits = blocks.select(F.monotonically_increasing_id().alias("row"), "*")
        hits = hits.select("width", "payload", "start", "doc_ids", "lengths", F.posexplode("doc_ids").alias("place", "doc"))
        hits = hits.join(asked, F.col("doc").eqNullSafe(F.col("asked")), "left_semi")
        blocks = hits.select("width", "payload", "start", "doc_ids", "lengths", F.array("place").alias("places"))
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            for i in range(batch.num_rows):
                width, payload, start, docs, lengths, places = (column[i].as_py() for column in batch.columns)
                ends = np.cumsum(lengths)
                lows, highs = (ends - lengths)[places], ends[places]
                low = int(lows.min())
                flat = unpack_bits(payload, width, low, int(highs.max()) - low).astype("<u4").tobytes()
                ids = [flat[4 * (a - low) : 4 * (b - low)] for a, b in zip(lows.tolist(), highs.tolist())]
                columns = [[docs[p] for p in places], start + lows, ids]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return blocks.mapInArrow(unpack, out)
