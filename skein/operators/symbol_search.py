"""Symbol search in tiers: exact name, then substring, then text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.answers import ranked, with_limits, within_limit
from skein.operators.grep import grep_requests
from skein.operators.name_index import matching_names
from skein.schemas import SEARCH_HITS, conform
from skein.session import cut, semi_join_by_size

# File types of the text tier.
SEARCHED_GLOBS = ["*.py", "*.js", "*.ts", "*.html"]

SHOWN = ["qualified_name", "kind", "file_path", "line_start", "summary"]


def _normal(requests: DataFrame, limit: int | None) -> tuple[DataFrame, int | None]:
    requests, top = with_limits(requests, limit)
    kind = F.nullif(F.col("kind"), F.lit("")) if "kind" in requests.columns else F.lit(None).cast("string")
    return cut(requests.select("request_id", "name", kind.alias("req_kind"), "lim"), "search-requests"), top


def _best_per_name(symbols: DataFrame, names: DataFrame, top: int | None) -> DataFrame:
    """The first symbols of every (name, kind): all that a limited answer can need of a name."""
    wanted = semi_join_by_size(symbols.select("name", *SHOWN), names, ["name"])
    return ranked(wanted, ["name", "kind"], ["qualified_name"], top).drop("rank")


def _kind_fits() -> Column:
    return F.isnull("req_kind") | (F.col("kind") == F.col("req_kind"))


def _answer(requests: DataFrame, asked: str, found: DataFrame, top: int | None) -> DataFrame:
    """Rank ``found`` per distinct (asked text, kind) and hand the rows to the requests that asked for them."""
    best = ranked(found, [asked, "req_kind"], ["qualified_name"], top)
    best = best.select(F.col(asked).alias("_asked"), F.col("req_kind").alias("_kind"), *SHOWN, "rank")
    joined = requests.join(best, (F.col("name") == F.col("_asked")) & F.col("req_kind").eqNullSafe(F.col("_kind")))
    hits = joined.filter(within_limit()).select("request_id", *SHOWN)
    return conform(hits.withColumn("source", F.lit("graph")), SEARCH_HITS)


def _exact(symbols: DataFrame, requests: DataFrame, top: int | None) -> DataFrame:
    wanted = requests.select("name", "req_kind").distinct()
    best = _best_per_name(symbols, wanted.select("name").distinct(), top)
    return _answer(requests, "name", best.join(wanted, "name").filter(_kind_fits()), top)


def _substring(symbols: DataFrame, requests: DataFrame, top: int | None, wildcards: bool, postings: DataFrame | None = None) -> DataFrame:
    """Case-insensitive substring tier. Only the symbols of as many matching names as the limit asks for are looked up."""
    wanted = requests.filter(F.isnotnull("name")).select(F.col("name").alias("asked"), "req_kind").distinct()
    matched = cut(matching_names(symbols, wanted, top, wildcards, postings), "substring-names")
    best = _best_per_name(symbols, matched.select("name").distinct(), top)
    found = best.join(matched, (best["name"] == matched["name"]) & best["kind"].eqNullSafe(matched["kind"]))
    return _answer(requests, "asked", found.select("asked", "req_kind", *[best[c] for c in SHOWN]), top)


def search_exact(symbols: DataFrame, requests: DataFrame, limit: int | None = 10) -> DataFrame:
    """Symbols whose name equals the requested one, case-sensitive."""
    requests, top = _normal(requests, limit)
    return _exact(symbols, requests, top)


def search_substring(
    symbols: DataFrame, requests: DataFrame, limit: int | None = 10, wildcards: bool = True, postings: DataFrame | None = None
) -> DataFrame:
    """Symbols whose name contains the requested text, whatever the case.

    With ``wildcards`` a ``%`` or ``_`` in the request matches as in SQL LIKE. ``postings`` is the ``grams`` table of a published index, or the lists that
    ``name_index.name_grams`` makes; without it they are made for the requests.
    """
    requests, top = _normal(requests, limit)
    return _substring(symbols, requests, top, wildcards, postings)


def search_symbol(
    symbols: DataFrame,
    requests: DataFrame,
    files: DataFrame | None = None,
    limit: int | None = 10,
    wildcards: bool = True,
    postings: DataFrame | None = None,
) -> DataFrame:
    """Tiered search for ``requests`` (``request_id, name[, kind][, lim]``).

    A request goes on to the next tier only when it has no answer yet: exact name, then substring,
    then, when ``files`` (``file_path, text``) are given, the lines that match the name as a basic
    regular expression. ``kind`` restricts the first two tiers. Rows are ordered by qualified name
    (graph) or path and line (text) before the limit cuts.
    """
    requests, top = _normal(requests, limit)
    exact = cut(_exact(symbols, requests, top), "exact-hits")
    open_requests = cut(requests.join(exact, "request_id", "left_anti"), "open-requests")
    substring = _substring(symbols, open_requests, top, wildcards, postings)
    hits = exact.unionByName(substring)
    if files is None:
        return hits
    substring = cut(substring, "substring-hits")
    open_requests = open_requests.join(substring, "request_id", "left_anti")
    asked = open_requests.select("request_id", F.col("name").alias("pattern"), "lim")
    text = grep_requests(files, asked, include=SEARCHED_GLOBS, limit=None, dialect="basic")
    return exact.unionByName(substring).unionByName(conform(text, SEARCH_HITS))


def display(hits: DataFrame) -> DataFrame:
    """One text per hit: ``[source] name-or-path - kind-or-relation-or-grep @ line``."""
    what = F.coalesce(*[F.col(c) for c in ("qualified_name", "from_qualified") if c in hits.columns], F.col("file_path"))
    label = F.coalesce(*[F.col(c) for c in ("kind", "relation") if c in hits.columns], F.lit("grep"))
    return hits.select(
        "request_id", F.format_string("[%s] %s - %s @ %d", "source", what, label, "line_start").alias("line")
    )
