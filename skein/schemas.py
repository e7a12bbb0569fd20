"""Column layouts of the tables and of the query answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTRA = T.MapType(T.StringType(), T.StringType())

SYMBOL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("summary", T.StringType()),
        T.StructField("raw_signature", T.StringType()),
        T.StructField("extra", EXTRA),
        T.StructField("ordinal", T.IntegerType()),
    ]
)

SYMBOLS = T.StructType(SYMBOL.fields + [T.StructField("last_indexed", T.TimestampType())])

FILES = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("module_path", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("symbol_count", T.IntegerType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("last_indexed", T.TimestampType()),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("from_qualified", T.StringType()),
        T.StructField("to_qualified", T.StringType()),
        T.StructField("relation", T.StringType()),
    ]
)

RAW_EDGES = T.StructType([T.StructField("file_path", T.StringType())] + EDGES.fields)

SEARCH_HITS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("summary", T.StringType()),
        T.StructField("match_text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

USAGE_HITS = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("from_qualified", T.StringType()),
        T.StructField("relation", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("match_text", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: columns it lacks become null, the others are cast."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(field.name) if field.name in present else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in schema.fields
        ]
    )
