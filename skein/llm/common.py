"""Helpers shared by the operators: columns they read, and task-side hashing of words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace that separates words: the space and the control characters 9 to 13. ``bytes.split()`` without an
# argument splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)``, whatever other columns ``docs`` has; a null text counts as empty."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def text_key(text_col: str = "text") -> Column:
    """64 bits over a text, null counting as empty; with the id it names a row where ids repeat."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name like ``name`` that is none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text key are in ``gone(doc_id, text_key)``."""
    own, key = fresh(docs.columns, "_gone_id"), fresh(docs.columns, "_gone_key")
    gone = gone.select(F.col("doc_id").alias(own), F.col("text_key").alias(key))
    same = F.col(id_col).eqNullSafe(F.col(own)) & (text_key(text_col) == F.col(key))
    return docs.join(gone, same, "left_anti")


def id_type(docs: DataFrame, id_col: str = "doc_id") -> T.DataType:
    return docs.schema[id_col].dataType


def schema(docs: DataFrame, id_col: str = "doc_id", **columns: str) -> T.StructType:
    """``doc_id`` with the type that ``id_col`` has in ``docs``, then ``columns`` given as name=type."""
    fields = [T.StructField("doc_id", id_type(docs, id_col))]
    return T.StructType(fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items()])


def arrow_batches(rows: Callable[[list, list], tuple], out: T.StructType, as_bytes: bool = False):
    """A ``mapInArrow`` body for ``(doc_id, text)``: ``rows(ids, texts)`` gives the columns of ``out``.

    Texts arrive as UTF-8 bytes when ``as_bytes`` is set.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            texts = batch.column(1)
            columns = rows(batch.column(0), (texts.cast(pa.binary()) if as_bytes else texts).to_pylist())
            yield pa.record_batch(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, target)],
                schema=target,
            )

    return run


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed longs Spark keeps."""
    return values.astype(np.uint64, copy=False).view(np.int64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys in sorted columns, with the length of the columns at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), n)
