"""Joins on a key that a few values dominate.

A frequent-items sketch (Spark's ``approx_top_k``: sketches of the tasks are merged) names the values that hold too large a share of the rows. Rows with such a
value are dealt over salts, and the few rows of the other side that match them are repeated for every salt; all other rows travel once. The sketch decides
where rows go and never which rows meet, so a value it overlooks or names for nothing costs time and no correctness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64
# A value with more than this share of the rows is hot; so no more than HOT_KEYS values can be.
HOT_SHARE = 1 / 128
HOT_KEYS = 128
# Counters of a sketch: its error is a fraction of the rows well below HOT_SHARE.
TRACKED = 8192


def hot_keys(rows: DataFrame, key: str) -> list:
    """The values of ``key`` with more than ``HOT_SHARE`` of the rows, at most ``HOT_KEYS``; nulls never match and are left out."""
    known = rows.filter(F.col(key).isNotNull())
    found = known.agg(F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in found["top"] if item["count"] > HOT_SHARE * found["n"]]


def salted_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``few`` on ``key``, hot values of ``rows`` spread over ``SALTS`` tasks.

    ``rows`` is read twice, so it should be a table or a cheap plan. No other column may be in both.
    """
    hot = hot_keys(rows, key)
    if not hot:
        return rows.join(few, key)
    is_hot = F.col(key).isin(hot)
    others = [F.col(f"`{c}`") for c in rows.columns if c != key]
    salt = F.when(is_hot, F.pmod(F.xxhash64(*others), F.lit(SALTS))).otherwise(0)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("_salt", salt.cast("int"))
    repeated = few.withColumn("_salt", F.explode(salts))
    return dealt.join(repeated, [key, "_salt"]).drop("_salt")
