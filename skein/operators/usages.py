"""Who uses a symbol: its in-edges, or text lines when it has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.answers import ranked, with_limits, within_limit
from skein.operators.grep import grep_requests
from skein.schemas import USAGE_HITS, conform
from skein.session import cut, semi_join_by_size


def graph_usages(symbols: DataFrame, edges: DataFrame, requests: DataFrame, limit: int | None = 20) -> DataFrame:
    """In-edges of the requested symbols (``request_id, qualified_name[, lim]``).

    ``line_start`` is where the using symbol starts. Edges are trimmed to the limit per target, in
    (name, relation) order, before anything is joined to them: a target with most of the edges is
    cut down inside every map task.
    """
    requests, top = with_limits(requests, limit)
    wanted = cut(requests.select(F.col("qualified_name").alias("to_qualified")).distinct(), "usage-targets")
    into = semi_join_by_size(edges, wanted, ["to_qualified"])
    best = ranked(into, ["to_qualified"], ["from_qualified", "relation"], top)
    asked = requests.select("request_id", F.col("qualified_name").alias("to_qualified"), "lim")
    users = symbols.select(F.col("qualified_name").alias("from_qualified"), "file_path", "line_start")
    hits = asked.join(best, "to_qualified").filter(within_limit()).join(users, "from_qualified")
    return conform(hits.withColumn("source", F.lit("graph")), USAGE_HITS)


def find_usages(
    symbols: DataFrame,
    edges: DataFrame,
    requests: DataFrame,
    files: DataFrame | None = None,
    limit: int | None = 20,
) -> DataFrame:
    """Usages from the graph; a request without any (unknown symbol or no in-edge) is answered from
    ``files`` (``file_path, text``) by the lines that hold the last part of its dotted name."""
    hits = graph_usages(symbols, edges, requests, limit)
    if files is None:
        return hits
    hits = cut(hits, "usage-hits")
    requests, _ = with_limits(requests, limit)
    last_part = F.element_at(F.split("qualified_name", r"\.", -1), -1)
    left = requests.join(hits, "request_id", "left_anti").select("request_id", last_part.alias("pattern"), "lim")
    text = grep_requests(files, left, limit=None, dialect="basic")
    return hits.unionByName(conform(text, USAGE_HITS))
