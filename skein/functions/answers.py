"""Per-key limits that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark trims groups before the shuffle (WindowGroupLimit) up to this limit.
TRIMMED_LIMIT = 1000
SALTS = 64


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], limit: int | None, rank: str = "rank"
) -> DataFrame:
    """First ``limit`` rows of every key in ``order``, with their position in ``rank``.

    Each map task trims its groups to ``limit`` rows before the shuffle. Past Spark's own bound for
    that trimming, groups are ranked in salted parts first. ``None`` keeps every row, unranked.
    """
    if limit is None:
        return df.withColumn(rank, F.lit(None).cast("int"))
    if limit < 0:
        raise ValueError("limit must not be negative")
    if limit > TRIMMED_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(SALTS))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_part", F.row_number().over(part))
        df = df.filter(F.col("_part") <= limit).drop("_salt", "_part")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def with_limits(requests: DataFrame, limit: int | None) -> tuple[DataFrame, int | None]:
    """Requests with a ``lim`` column, and the largest limit asked for.

    A ``lim`` column of the caller's wins over ``limit``; null there means ``limit``.
    """
    if "lim" not in requests.columns:
        return requests.withColumn("lim", F.lit(limit).cast("int")), limit
    requests = requests.withColumn("lim", F.coalesce(F.col("lim").cast("int"), F.lit(limit).cast("int")))
    bounds = requests.agg(F.max("lim").alias("top"), F.min("lim").alias("low"), F.count_if(F.isnull("lim")).alias("open")).first()
    if bounds["low"] is not None and bounds["low"] < 0:
        raise ValueError("limit must not be negative")
    if bounds["open"] and bounds["top"] is not None:
        raise ValueError("either every request has a limit or none has")
    return requests, bounds["top"]


def within_limit(rank: str = "rank") -> Column:
    """The rank filter after answers have been joined back to their requests."""
    return F.isnull("lim") | (F.col(rank) <= F.col("lim"))
