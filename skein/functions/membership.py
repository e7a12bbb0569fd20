"""Bitmaps that tell cheaply, and with a few false alarms, whether a value is in a column.

They are built by Spark's bitmap aggregates (partial bitmaps of the tasks are merged bit by bit) and tested in the stage that scans the other table, before any
of its rows is shuffled. Their size is fixed by ``bits``, whatever the number of values; past about a value per bit they stop nothing, and the join that
follows still decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of one bitmap of Spark's bitmap functions, of the smallest and of the largest table of bitmaps (16 MB).
BITMAP_BITS = 32_768
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def bits_for(values: int) -> int:
    """A power of two with about sixteen bits for each value, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * values).bit_length()))


def _place(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits)) + 1


def membership(values: DataFrame, column: str, bits: int) -> DataFrame:
    """``part, bitmap``: at most ``bits / BITMAP_BITS`` rows of 4 KB."""
    place = _place(F.col(column), bits)
    parts = values.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("position"))
    return parts.groupBy("part").agg(F.bitmap_construct_agg("position").alias("bitmap"))


def may_be_in(rows: DataFrame, column: str, members: DataFrame, bits: int) -> DataFrame:
    """The rows whose ``column`` may be among the ``members``, and all whose value is.

    The table of bitmaps is broadcast: ``bits`` bounds it at ``MOST_BITS / 8`` bytes.
    """
    if bits > MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} bits")
    part, bitmap, place = "_member_part", "_member_bitmap", _place(F.col(column), bits)
    known = members.select(F.col("part").alias(part), F.col("bitmap").alias(bitmap))
    met = rows.join(F.broadcast(known), F.bitmap_bucket_number(place) == F.col(part))
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0).select(*[F.col(f"`{c}`") for c in rows.columns])
