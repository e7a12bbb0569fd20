"""Regex and literal search over the lines of a corpus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.answers import ranked, with_limits, within_limit
from skein.functions.paths import base_name_matches, directory_matches
from skein.functions.patterns import matches, may_match_file
from skein.functions.text import strip
from skein.operators.multi_search import find_literals
from skein.session import cut, semi_join_by_size
from skein.sources.lines import numbered_lines, searchable

# Expressions that no text can be told from, tested in one pass over the lines.
EXPRESSIONS_PER_PASS = 256


def search_scope(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Files to search: base name matches an include glob, no directory matches an exclude glob, not binary."""
    if include:
        files = files.filter(base_name_matches(F.col("file_path"), include))
    if exclude:
        files = files.filter(~directory_matches(F.col("file_path"), exclude))
    return searchable(files.select("file_path", "text"))


def _shown(found: DataFrame, *keys: str) -> DataFrame:
    """The answer columns; stripping comes last, when the limit has been applied."""
    return found.select(
        *keys, "file_path", "line_start", strip(F.col("text")).alias("match_text"), F.lit("grep").alias("source")
    )


def grep(
    files: DataFrame,
    pattern: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    limit: int | None = 30,
    dialect: str = "java",
) -> DataFrame:
    """Lines of ``files`` (``file_path, text``) that hold a match of ``pattern``, in path and line order.

    Answers ``file_path, line_start, match_text, source``; ``limit=None`` gives every line.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    scope = search_scope(files, include, exclude)
    whole = may_match_file(F.col("text"), pattern, dialect)
    if whole is not None:
        scope = scope.filter(whole)
    found = numbered_lines(scope).filter(matches(F.col("text"), pattern, dialect))
    found = found.withColumnRenamed("line_no", "line_start")
    if limit is not None:
        found = found.orderBy("file_path", "line_start").limit(limit)
    return _shown(found)


def _match_as_expressions(scope: DataFrame, patterns: Sequence[str], dialect: str) -> DataFrame:
    """Test every line against a bounded list of patterns; one row per line and matching pattern."""
    text = F.col("text")
    coarse = [may_match_file(text, p, dialect) for p in patterns]
    if patterns and all(c is not None for c in coarse):
        scope = scope.filter(reduce(Column.__or__, coarse))
    # a plain array is exploded inside generated code and tests every pattern once
    tests = F.array(*[F.when(matches(text, p, dialect), F.lit(p)) for p in patterns])
    return numbered_lines(scope).withColumn("pattern", F.explode(tests)).filter(F.isnotnull("pattern"))


def grep_requests(
    files: DataFrame,
    requests: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    limit: int | None = 30,
    dialect: str = "java",
) -> DataFrame:
    """``grep`` for a table of ``request_id, pattern[, lim]``; the limit holds per request.

    Equal patterns are searched once. Answers ``request_id`` and the columns of ``grep``. Null patterns have no answer.

    All patterns are searched in one pass over the files, with a limit after one over a share of them (see ``multi_search``); a task gives out no more places of a literal than the limit. Only expressions
    without any text of their own, such as ``[a-z]*``, are tested line by line.
    """
    requests, top = with_limits(requests, limit)
    patterns = cut(requests.filter(F.isnotnull("pattern")).select("pattern").distinct(), "patterns")
    scope = search_scope(files, include, exclude)
    found, others = find_literals(scope, patterns, dialect, top)
    for first in range(0, len(others), EXPRESSIONS_PER_PASS):
        met = _match_as_expressions(scope, others[first : first + EXPRESSIONS_PER_PASS], dialect).withColumnRenamed("line_no", "line_start")
        met = ranked(met, ["pattern"], ["file_path", "line_start"], top)
        found = found.unionByName(cut(met.select(*found.columns), "grep-expressions"))
    places = ranked(found.select("pattern", "file_path", "line_start"), ["pattern"], ["file_path", "line_start"], top)
    texts = found.filter(F.isnotnull("text"))
    if top is not None:
        # only the lines shown travel
        places = cut(places, "grep-places")
        texts = semi_join_by_size(texts, places.select("file_path", "line_start"), ["file_path", "line_start"])
    texts = texts.groupBy("file_path", "line_start").agg(F.first("text").alias("text"))
    best = places.join(texts, ["file_path", "line_start"])
    return _shown(requests.join(best, "pattern").filter(within_limit()), "request_id")
