"""Exact duplicates: one document of every group of equal texts stays.

Documents are grouped by a 128-bit hash of the normalised text; an aggregate by (hash, text) compares the bytes inside
every group, so texts that merely share a hash are told apart. Copies met in one map task collapse before the shuffle.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_and_text
from skein.session import cut

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    content_hash: Callable[[Column], Column] = md5_bytes,
) -> DataFrame:
    """Every row of ``docs`` with ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` is "min" or "max": which id of a group stays. Null texts are equal to empty ones. Rows that repeat an id with an
    equal text count in ``group_size`` and are ``kept`` together. A null id never stays while the group has another;
    a group of null ids only has a null ``keep_id`` and is kept. An empty table gives no rows; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").alias("id"), lower_ascii(F.col("text")).alias("text"))
    found = equal_texts(rows.withColumn("sha", F.unhex(F.sha2("text", 256))), keep, content_hash, ["sha"])
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def equal_texts(
    rows: DataFrame, keep: str = "min", content_hash: Callable[[Column], Column] = md5_bytes, carried: Sequence[str] = ()
) -> DataFrame:
    """``id, keep_id, group_size`` and the ``carried`` columns of every row of ``rows(id, text, ...)``.

    ``keep_id`` is the smallest or largest id among the rows with the same bytes, ``group_size`` their number. ``rows`` is
    evaluated twice, and its texts are shuffled once at most.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = rows.withColumn("hash", content_hash(F.col("text")))
    classes = rows.groupBy("hash", "text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = classes.groupBy("hash").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    repeated = cut(by_hash.filter((F.col("group_size") > 1) | (F.col("texts") > 1)), "copies")
    light = rows.select("id", "hash", *carried).join(repeated, "hash", "left")
    single = F.isnull("texts")
    found = light.filter(single | (F.col("texts") == 1)).select(
        "id",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(single, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        *carried,
    )
    clashing = repeated.filter(F.col("texts") > 1).select("hash")
    if clashing.isEmpty():
        return found
    told_apart = rows.join(clashing, "hash", "left_semi")
    classes = told_apart.groupBy("hash", "text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    exact = told_apart.join(cut(classes, "clashes"), ["hash", "text"])
    return found.unionByName(exact.select("id", "keep_id", "group_size", *carried))
