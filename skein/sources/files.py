"""The source-tree scan and what narrows it before a file is parsed."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.membership import may_be_in, membership
from skein.functions.paths import base_name, base_name_matches, contains_any, segments
from skein.functions.text import decode_utf8
from skein.session import cut

# The default exclude list.
DEFAULT_EXCLUDE = [
    ".git",
    "node_modules",
    "__pycache__",
    ".venv",
    "dist",
    "build",
    ".tox",
    ".pytest_cache",
    "migrations",
]


LISTED = "path string, is_dir boolean"
READ = "path string, content binary"
BATCH_BYTES = 16 * 1024 * 1024
ENTRIES_AT_ONCE = 10_000
# Bits of the filter over the paths of a listing (1 MB).
LISTING_BITS = 1 << 23


_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*)://([^/]*)(.*)", re.S)


@lru_cache(maxsize=64)
def _store(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and what it puts in front of paths."""
    system, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, base.rstrip("/")


def _opened(path: str) -> tuple[fs.FileSystem, str, str, str]:
    """File system and plain path of ``path``, and by what the start of such a plain path is replaced to name it again.

    Only scheme and authority are read as a URI: what follows is the name as it is, with any ``#``, ``?``, ``%`` or blank in it.
    """
    uri = _URI.match(path)
    if not uri:
        return fs.LocalFileSystem(), path, "", ""
    scheme, authority, rest = uri.groups()
    system, base = _store(scheme, authority)
    return system, base + rest, base, f"{scheme}://{authority}"


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            system, inner, base, prefix = _opened(folder)
            local = isinstance(system, fs.LocalFileSystem)
            entries = [e for e in system.get_file_info(fs.FileSelector(inner)) if e.type != fs.FileType.NotFound]
            for first in range(0, len(entries), ENTRIES_AT_ONCE):
                some = entries[first : first + ENTRIES_AT_ONCE]
                # like a plain walk, do not enter linked directories: they may lead back up
                some = [e for e in some if not (local and e.type == fs.FileType.Directory and os.path.islink(e.path))]
                paths = pa.array([prefix + e.path[len(base) :] for e in some], pa.string())
                is_dir = pa.array([e.type == fs.FileType.Directory for e in some], pa.bool_())
                yield pa.RecordBatch.from_arrays([paths, is_dir], ["path", "is_dir"])


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        paths, contents = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    for batch in batches:
        rows, size = [], 0
        for path in batch.column("path").to_pylist():
            system, inner, _, _ = _opened(path)
            try:
                # raw bytes, whatever the name ends in
                with system.open_input_stream(inner, compression=None) as stream:
                    rows.append((path, stream.read()))
            except (FileNotFoundError, PermissionError):
                continue  # listed, but gone or not ours to read; any other error fails the task, which is tried again
            size += len(rows[-1][1])
            if size >= BATCH_BYTES:
                yield flush(rows)
                rows, size = [], 0
        yield flush(rows)


def _spread(paths: DataFrame) -> DataFrame:
    return paths.repartition("path")


def walk_tree(
    spark: SparkSession, root: str, prune: Sequence[str] | None = None, enter: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``path`` of every file below ``root`` (a local path or a URI), one job per directory level.

    Directories are listed by the tasks. With ``prune``, hidden directories and those with one of these
    exact names are not entered, with ``enter`` only those whose path it holds for. Names of files are taken as they are, also below a URI. Spark's own file sources are no help here: they leave out empty
    files and names that start with ``_`` or ``.``, such as ``__init__.py``.
    """
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    found = []
    while True:
        listed = cut(level.mapInArrow(_list_directories, LISTED), "walk")
        found.append(listed.filter(~F.col("is_dir")).select("path"))
        level = listed.filter("is_dir").select("path")
        if prune is not None:
            name = base_name(F.col("path"))
            level = level.filter(~(name.isin(*prune) | F.startswith(name, F.lit("."))))
        if enter is not None:
            level = level.filter(enter(F.col("path")))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = _spread(level)


def read_files(paths: DataFrame) -> DataFrame:
    """``path, content`` of the files in ``paths``; a path that is gone or may not be read is skipped."""
    return _spread(paths.select("path")).mapInArrow(_read_files, READ)


def _relative(path: Column, root: str, prefix: str | None) -> Column:
    base = root.rstrip("/")
    prefix = base.rsplit("/", 1)[-1] if prefix is None else prefix.rstrip("/")
    inside = F.substr(path, F.lit(len(base) + 2))
    return F.concat(F.lit(prefix + "/"), inside) if prefix else inside


def scan_tree(
    spark: SparkSession,
    root: str,
    prefix: str | None = None,
    globs: Sequence[str] = (),
    prune: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    listing: DataFrame | None = None,
) -> DataFrame:
    """Every file below ``root`` as ``file_path, content``.

    Paths are relative to ``root`` and start with ``prefix`` (the base name of ``root`` when not given,
    nothing when empty), so that ``scan_tree(spark, "/data/src")`` yields ``src/app/models.py``.
    Only files whose base name matches one of ``globs``, whose path holds none of the ``exclude`` strings and, with a
    ``listing`` (``file_path``), which it lists are read; ``prune`` is that of ``walk_tree``. A directory below which every path would hold an ``exclude``
    string is not even listed.
    """

    def enter(path: Column) -> Column:
        return ~contains_any(F.concat(_relative(path, root, prefix), F.lit("/")), list(exclude))

    paths = walk_tree(spark, root, prune, enter if exclude else None)
    if globs:
        paths = paths.filter(base_name_matches(F.col("path"), globs))
    named = paths.withColumn("file_path", _relative(F.col("path"), root, prefix))
    if exclude:
        named = drop_excluded(named, exclude)
    if listing is not None:
        named = restrict_to(named, listing)
    return read_files(named).select(_relative(F.col("path"), root, prefix).alias("file_path"), "content")


def scan_listed(listing: DataFrame, root: str, prefix: str | None = None) -> DataFrame:
    """The files of a listing (``file_path`` relative to ``root``) without a walk: tracked or changed files."""
    paths = listing.select(F.concat(F.lit(root.rstrip("/") + "/"), F.col("file_path")).alias("path")).distinct()
    return read_files(paths).select(_relative(F.col("path"), root, prefix).alias("file_path"), "content")


def from_table(df: DataFrame, path: str, content: str) -> DataFrame:
    """Any table with a path and a text or binary column as a file scan."""
    return df.select(F.col(path).alias("file_path"), F.col(content).cast("binary").alias("content"))


def prune_walk(scan: DataFrame, exclude: Sequence[str] = DEFAULT_EXCLUDE, root_depth: int = 1) -> DataFrame:
    """Drop files below a directory that is hidden or whose exact name is excluded (the walk without a listing).

    The first ``root_depth`` segments are the root itself, which a walk enters whatever it is called.
    """
    parts = segments(F.col("file_path"))
    folders = F.slice(parts, F.lit(root_depth + 1), F.greatest(F.size(parts) - root_depth - 1, F.lit(0)))
    return scan.filter(~F.exists(folders, lambda name: name.isin(*exclude) | F.startswith(name, F.lit("."))))


def restrict_to(scan: DataFrame, listing: DataFrame) -> DataFrame:
    """Only the listed paths; a listed path that is not there is skipped.

    A bitmap over the listing drops most other files in the stage that reads them, so their content does not reach the join.
    """
    listed = listing.select("file_path")
    return may_be_in(scan, "file_path", membership(listed, "file_path", LISTING_BITS), LISTING_BITS).join(listed, "file_path", "left_semi")


def drop_excluded(scan: DataFrame, exclude: Sequence[str] | None = None) -> DataFrame:
    """Drop a file when any exclude string is a substring of its whole path.

    A given list replaces the default one; an empty list means the default.
    """
    return scan.filter(~contains_any(F.col("file_path"), list(exclude or DEFAULT_EXCLUDE)))


def dispatch(path: Column, handlers: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first handler whose condition holds, null for a file nobody handles."""
    chosen = F.lit(None).cast("string")
    for name, condition in reversed(handlers):
        chosen = F.when(condition, F.lit(name)).otherwise(chosen)
    return chosen


def with_hash(scan: DataFrame) -> DataFrame:
    """SHA-256 of the raw bytes as ``content_hash``."""
    return scan.withColumn("content_hash", F.sha2("content", 256))


def with_text(scan: DataFrame) -> DataFrame:
    """Decoded content as ``text``; the bytes are dropped."""
    return scan.withColumn("text", decode_utf8(F.col("content"))).drop("content")
