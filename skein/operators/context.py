"""Lines around a position, and the head of a file the index does not know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.membership import bits_for, may_be_in, membership
from skein.functions.text import TEXT_MODE_NEWLINE, line_blocks, line_count, right_strip, split_lines, strip
from skein.session import cut, fits_broadcast, semi_join_by_size

# Texts are cut into blocks of so many lines, and blocks are matched to requests; a file with many requests spreads over tasks.
BLOCK = 64


def _missing(path: Column) -> Column:
    # Fixed value: the message of a file that is not there.
    return F.concat(F.lit("[Errno 2] No such file or directory: '"), path, F.lit("'"))


def _block(line: Column) -> Column:
    return F.floor((line - 1) / BLOCK)


def _place_of(path: str, block: str) -> Column:
    return F.xxhash64(F.col(path), F.col(block).cast("long"))


def line_context(files: DataFrame, requests: DataFrame, radius: int = 30) -> DataFrame:
    """``request_id, context`` for ``request_id, file_path, line[, radius]``.

    The context is the lines ``line - radius .. line + radius`` that exist, each as ``number: text``
    without trailing blanks. It is empty past the end of the file, and an error text for an unknown file.
    """
    reach = F.coalesce("radius", F.lit(radius)) if "radius" in requests.columns else F.lit(radius)
    requests = requests.select(
        "request_id",
        "file_path",
        F.greatest(F.lit(1).cast("long"), F.col("line").cast("long") - reach).alias("first"),
        (F.col("line").cast("long") + reach).alias("last"),
    )
    requests = cut(requests, "context-requests")
    # a filter of the scan if few files are asked for; else no text travels to find its size
    paths = cut(requests.select("file_path").distinct(), "context-paths")
    asked = files.select("file_path", "text")
    if fits_broadcast(paths):
        asked = asked.join(F.broadcast(paths), "file_path", "left_semi")
    sizes = asked.select("file_path", line_count(F.col("text"), TEXT_MODE_NEWLINE).alias("n_lines"))
    # cut what lies past the end before a request is spread over its blocks
    placed = cut(
        requests.join(sizes, "file_path", "left").withColumn("last", F.least("last", "n_lines")), "context-ranges"
    )
    # without a size the end of an unknown file would be that of the request, however large its radius
    wanted = placed.filter("n_lines IS NOT NULL AND first <= last").select(
        "request_id",
        "file_path",
        "first",
        "last",
        F.explode(F.sequence(_block(F.col("first")), _block(F.col("last")))).alias("block"),
    )
    wanted = cut(wanted, "context-blocks")
    # one row per block of lines; a bitmap stops most blocks that nobody asks for before the join moves their text, the only time it travels
    blocks = asked.select("file_path", F.posexplode(line_blocks(F.col("text"), BLOCK)).alias("block", "lines"))
    named = wanted.select(_place_of("file_path", "block").alias("_place")).distinct()
    bits = bits_for(named.count())
    blocks = may_be_in(blocks.withColumn("_place", _place_of("file_path", "block")), "_place", membership(named, "_place", bits), bits).drop("_place")
    before = (F.col("block") * BLOCK).cast("int")
    skipped = F.greatest(F.lit(0), (F.col("first") - 1).cast("int") - before)
    number = before + skipped + 1
    inside = F.slice(split_lines(F.col("lines"), TEXT_MODE_NEWLINE), skipped + 1, F.least(F.lit(BLOCK), F.col("last").cast("int") - before) - skipped)
    shown = F.transform(inside, lambda line, i: F.concat((number + i).cast("string"), F.lit(": "), right_strip(line)))
    pieces = blocks.join(wanted, ["file_path", "block"]).select("request_id", "block", F.array_join(shown, "\n").alias("shown"))
    # a group is at most the blocks of 2 * radius + 1 lines of one file
    joined = pieces.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("block", "shown"))).alias("all"))
    texts = joined.select("request_id", F.array_join(F.col("all.shown"), "\n").alias("context"))
    error = F.concat(F.lit("Error reading file: "), _missing(F.col("file_path")))
    return placed.join(texts, "request_id", "left").select(
        "request_id", F.coalesce("context", F.when(F.isnull("n_lines"), error), F.lit("")).alias("context")
    )


def file_head(files: DataFrame, indexed: DataFrame, requests: DataFrame, n_lines: int = 5) -> DataFrame:
    """First lines of every requested ``file_path`` that the index (``indexed``) does not hold.

    Answers ``file_path, error, head, source``. A file with fewer than ``n_lines`` lines or no such
    file gives an error row without a head.
    """
    asked = requests.select("file_path").distinct().join(indexed.select("file_path"), "file_path", "left_anti")
    asked = cut(asked, "head-requests")
    scope = semi_join_by_size(files.select("file_path", "text"), asked, ["file_path"])
    parts = F.split("text", TEXT_MODE_NEWLINE, n_lines + 1)
    has_all = (F.size("parts") > n_lines) | ((F.size("parts") == n_lines) & (F.element_at("parts", -1) != ""))
    heads = scope.select("file_path", parts.alias("parts")).select(
        "file_path",
        F.lit(True).alias("found"),
        F.when(has_all, F.transform(F.slice("parts", 1, n_lines), strip)).alias("head"),
    )
    # The two error texts.
    unreadable = F.concat(F.lit("Could not read file: "), F.when(F.isnull("found"), _missing(F.col("file_path"))).otherwise(""))
    return asked.join(heads, "file_path", "left").select(
        "file_path",
        F.when(F.isnotnull("head"), F.lit("File not indexed")).otherwise(unreadable).alias("error"),
        "head",
        F.when(F.isnotnull("head"), F.lit("fallback")).alias("source"),
    )
