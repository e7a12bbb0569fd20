"""From raw documents to packed training sequences: five stages, each written as a table before the next reads it.

Quality rules reject documents, line dedup takes repeated chunks out of texts, of near duplicates one document stays, repeated
passages go from all but the first document that has them, and what is left is encoded and packed. A document that loses all its
text stays with an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import fresh, text_key, without_rows
from skein.llm.line_dedup import without_repeated_chunks
from skein.llm.quality_rules import quality_rules
from skein.llm.queries import packed_documents
from skein.llm.simhash import near_duplicates
from skein.llm.substring_dedup import substring_duplicates
from skein.session import cut

# Words of a shingle in the near-duplicate stage; fingerprints link at three or fewer differing bits.
SHINGLE_WORDS = 3


def _retexted(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text, and its length in ``n_chars`` where there is such a column."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(F.coalesce(text, F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return docs.withColumns(new)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that the quality rules reject.

    Null and empty texts have too few words and go. Rows that repeat id and text share a verdict; one with a null id is judged like any other. An empty table gives an
    empty one; all columns stay.
    """
    judged = quality_rules(docs)
    return without_rows(docs, judged.filter(~F.col("kept")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the chunks of lines that a smaller id has, or that stand further up in the same text.

    Every row and column stays; a null text stays null, one that loses all is empty. Rows that repeat id and text are one document. An empty table gives an empty one.
    """
    left = without_repeated_chunks(docs).select(F.col("text").alias("text"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return _retexted(left, F.col("text")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id.

    Texts without words, null or empty, are one group. Null ids go when their group has another id; else they stay. Rows that repeat the smallest id all stay. An
    empty table gives an empty one; all columns stay.
    """
    found = near_duplicates(docs, SHINGLE_WORDS)
    return without_rows(docs, found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the windows of words that a smaller id has.

    A text that loses nothing stays as it is, null included; another is its words left, joined by one space. Null ids lose nothing. Rows that repeat an id are one
    document. An empty table gives an empty one; all rows and columns stay.
    """
    own, key, kept = (fresh(docs.columns, name) for name in ("_id", "_key", "_kept"))
    found = substring_duplicates(docs).filter(F.isnotnull("kept_text"))
    found = found.select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("kept_text").alias(kept)).dropDuplicates([own, key])
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (text_key() == F.col(key))
    return _retexted(docs.join(found, same, "left"), F.coalesce(F.col(kept), F.col("text"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all ``docs`` in their sequences; a null or empty text is its end id. Each row is a document; an empty table gives no rows."""
    return packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

# Fingerprints, content-defined borders and byte-level BPE are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
