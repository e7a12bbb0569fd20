"""The corpus as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import NEWLINE, split_lines


def numbered_lines(files: DataFrame, line_end: str = NEWLINE) -> DataFrame:
    """``file_path, text`` -> ``file_path, line_no, text`` with one row per line, numbered from 1."""
    return files.select("file_path", F.posexplode(split_lines(F.col("text"), line_end)).alias("pos", "text")).select(
        "file_path", (F.col("pos") + 1).alias("line_no"), "text"
    )


def searchable(files: DataFrame) -> DataFrame:
    """Files a line search looks into: binary ones, i.e. those with a NUL, are left out."""
    return files.filter(~F.contains("text", F.lit("\0")))
