"""Removal of repeated multi-line chunks, with chunk borders that the lines themselves choose.

A rolling hash over the hashes of neighbouring word lines marks half of them, and the last of a run of marked ones ends a chunk. A border
depends on the lines around it alone, so a passage is cut in the same way wherever it stands, but for its ends, and no chunk
is a single line. Chunks with equal bytes are grouped over all documents, and all but the first are taken out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import fresh, id_and_text, id_type, text_key
from skein.llm.exact_dedup import equal_texts
from skein.llm.hashing import mix, rolling

# Word lines that the rolling hash looks at, and word lines per chunk on average.
REACH = 2
SPACING = 4


def chunk_ends(lines: list[bytes], reach: int = REACH, spacing: int = SPACING) -> list[int]:
    """The ends of the chunks of a text: each is one past a chunk's last line, and the last is the number of lines.

    Borders are set on the lines that hold a word; others go with the word line before them, those at the start with the first chunk. A word
    line is marked when the rolling hash that ends there is low, and closes its chunk when the next one is not marked. So no two in a
    row close one, every chunk has at least two word lines if the text has, and one word line in ``spacing`` (4 or more) is an end.
    """
    from xxhash import xxh3_64_digest

    places = [i for i, line in enumerate(lines) if line.strip()]
    if len(places) <= reach + 1:
        return [len(lines)]
    hashes = np.frombuffer(b"".join(xxh3_64_digest(lines[i]) for i in places), ">u8").astype(np.uint64)
    low = mix(rolling(hashes, reach), 5) < np.uint64((1 - (1 - 4 / spacing) ** 0.5) / 2 * 2**64)
    closing = np.flatnonzero(low[:-1] & ~low[1:]) + reach - 1
    after = closing[(closing > 0) & (closing < len(places) - 2)] + 1
    return [*(places[i] for i in after.tolist()), len(lines)]


def chunks(text: bytes, reach: int = REACH, spacing: int = SPACING) -> list[tuple[int, int, bool]]:
    """``(first line, end, multi-line)`` of every chunk; a chunk is multi-line when two of its lines hold a word, as it is when two of the
    text do."""
    lines = text.split(b"\n")
    starts, out = 0, []
    for end in chunk_ends(lines, reach, spacing):
        out.append((starts, end, sum(1 for line in lines[starts:end] if line.strip()) > 1))
        starts = end
    return out


def _chunk_rows(reach: int, spacing: int, out: T.StructType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            rows, numbers, texts = [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                lines = text.split(b"\n")
                for number, (start, end, multi) in enumerate(chunks(text, reach, spacing)):
                    if multi:
                        rows.append(i)
                        numbers.append(number)
                        texts.append(b"\n".join(lines[start:end]).decode())
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return run


def repeated_chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, spacing: int = SPACING
) -> DataFrame:
    """``doc_id, text_key, removed``: the numbers of the chunks that go, for documents that lose any.

    A multi-line chunk goes when an equal one stands in a document with a smaller id, or further up in its own. Null ids come after
    all others. Rows that repeat id and text are one document. ``text_key`` is Spark's xxhash64 of the text, null counting as empty.
    """
    key = [T.StructField("doc_id", id_type(docs, id_col)), T.StructField("text_key", T.LongType())]
    out = T.StructType([*key, T.StructField("chunk", T.IntegerType()), T.StructField("text", T.StringType())])
    texts = id_and_text(docs, id_col, text_col).select("doc_id", text_key().alias("text_key"), "text")
    rows = texts.mapInArrow(_chunk_rows(reach, spacing, out), out)
    place = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_key", "chunk")
    found = equal_texts(rows.select(place.alias("id"), "text"))
    gone = found.filter(F.col("id") != F.col("keep_id"))
    return gone.groupBy("id.doc_id", "id.text_key").agg(F.collect_set("id.chunk").alias("removed"))


def _without(reach: int, spacing: int, at: int, out: T.StructType):
    """Rows of documents, with the chunks to remove as the last column, to rows with the text left and two counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            n_lines, n_removed, left = [], [], []
            for text, removed in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                lines = (text or "").split("\n")
                kept = text
                if removed:
                    gone = set(removed)
                    places = chunks(text.encode(), reach, spacing)
                    kept = "\n".join(line for k, (a, b, _) in enumerate(places) if k not in gone for line in lines[a:b])
                    n_removed.append(sum(b - a for k, (a, b, _) in enumerate(places) if k in gone))
                else:
                    n_removed.append(0)
                n_lines.append(len(lines))
                left.append(kept)
            columns = [left if i == at else c for i, c in enumerate(batch.columns[:-1])] + [n_lines, n_removed]
            yield pa.record_batch([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return run


def without_repeated_chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, spacing: int = SPACING
) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and ``n_lines`` and ``n_removed`` (lines, as they were).

    Every row and column of ``docs`` stays; columns of those two names are replaced. A text that loses nothing stays as it is, null
    included; one that loses all is empty. An empty table gives no rows.
    """
    own, key, gone = (fresh(docs.columns, name) for name in ("_doc_id", "_text_key", "_removed"))
    removed = repeated_chunks(docs, id_col, text_col, reach, spacing).select(
        F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("removed").alias(gone)
    )
    kept = docs.drop(*{"n_lines", "n_removed"} - {id_col, text_col})
    kept = kept.withColumn(text_col, F.col(text_col).cast("string"))
    same = F.col(id_col).eqNullSafe(F.col(own)) & (text_key(text_col) == F.col(key))
    marked = kept.join(removed, same, "left").select(*[F.col(f"`{c}`") for c in kept.columns], gone)
    out = T.StructType([*kept.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return marked.mapInArrow(_without(reach, spacing, kept.columns.index(text_col), out), out)
