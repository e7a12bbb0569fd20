"""Keeping the files, symbols and edges tables up to date: copy-on-write steps as joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.membership import may_be_in, membership
from skein.session import cut, fits_broadcast, semi_join_by_size

EDGE_KEY = ["from_qualified", "to_qualified", "relation"]

# Bits of the filter over all names (4 MB): with two million names it lets one of twenty strangers through.
FILTER_BITS = 1 << 25


def changed_files(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned rows whose path is new or whose hash differs from the stored one.

    Only path and hash are compared; file content is never part of a shuffle unless the changed
    set itself is too big to broadcast.
    """
    known = files.select("file_path", "content_hash")
    keys = scan.select("file_path", "content_hash").join(known, ["file_path", "content_hash"], "left_anti")
    if set(scan.columns) == {"file_path", "content_hash"}:
        return keys
    keys = cut(keys.select("file_path"), "changed")
    return scan.join(F.broadcast(keys) if fits_broadcast(keys) else keys, "file_path", "left_semi")


def dedupe_symbols(symbols: DataFrame) -> DataFrame:
    """First occurrence of a qualified name within its file."""
    window = Window.partitionBy("file_path", "qualified_name").orderBy("ordinal")
    return symbols.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def name_conflicts(symbols: DataFrame) -> DataFrame:
    """Qualified names claimed by more than one file, with the number of files."""
    # min and max combine before the shuffle, so a name that fills a table still is one row per task;
    # only the names in conflict go through the exact count
    spread = symbols.groupBy("qualified_name").agg(F.min("file_path").alias("_lo"), F.max("file_path").alias("_hi"))
    clashing = spread.filter("_lo <> _hi").select("qualified_name")
    per_file = symbols.join(clashing, "qualified_name", "left_semi").select("qualified_name", "file_path").distinct()
    return per_file.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("n_files"))


def owners(symbols: DataFrame) -> DataFrame:
    """Who owns each qualified name: ``qualified_name, file_path``."""
    return symbols.select("qualified_name", "file_path")


def lost_claims(claims: DataFrame, on_conflict: str = "error") -> DataFrame | None:
    """Claims ``qualified_name, file_path`` that lose their name to the smallest path with it; null when there are none.

    ``error`` fails instead, as in ``settle_conflicts``.
    """
    if on_conflict == "error":
        settle_conflicts(claims)
        return None
    if on_conflict != "first":
        raise ValueError(f"unknown on_conflict {on_conflict!r}")
    owner = claims.groupBy("qualified_name").agg(F.min("file_path").alias("_owner"))
    lost = cut(claims.join(owner, "qualified_name").filter("file_path <> _owner").select("qualified_name", "file_path").distinct(), "lost-claims")
    return None if lost.isEmpty() else lost


def settle_conflicts(symbols: DataFrame, on_conflict: str = "error") -> DataFrame:
    """Make ``qualified_name`` unique in the corpus.

    ``error`` fails the run when two files claim a name; ``first`` keeps the claim of the smallest path.
    """
    if on_conflict == "error":
        clash = name_conflicts(symbols).first()
        if clash:
            raise ValueError(f"{clash['qualified_name']} is defined in {clash['n_files']} files")
        return symbols
    if on_conflict != "first":
        raise ValueError(f"unknown on_conflict {on_conflict!r}")
    owner = symbols.groupBy("qualified_name").agg(F.min("file_path").alias("file_path"))
    return symbols.join(owner, ["qualified_name", "file_path"], "left_semi")


def file_rows(handled: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of the files table for ``handled`` (``file_path, module_path, content_hash``).

    The count is taken after de-duplication; a file without symbols has 0.
    """
    counts = symbols.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("symbol_count"))
    return handled.join(counts, "file_path", "left").select(
        "file_path",
        "module_path",
        F.lit(None).cast("string").alias("summary"),
        F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"),
        "content_hash",
        F.current_timestamp().alias("last_indexed"),
    )


def replace_by_file(table: DataFrame, changed: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with every row of a changed file replaced by ``rows``; other files keep theirs."""
    kept = table.join(changed.select("file_path"), "file_path", "left_anti").select(*table.columns)
    return kept.unionByName(rows, allowMissingColumns=True)


def upsert_files(files: DataFrame, new_rows: DataFrame) -> DataFrame:
    return replace_by_file(files, new_rows, new_rows)


def replace_symbols(symbols: DataFrame, changed: DataFrame, new_symbols: DataFrame) -> DataFrame:
    return replace_by_file(symbols, changed, new_symbols)


def cascade_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those that touch a removed ``qualified_name`` at either end."""
    gone = removed.select("qualified_name").distinct()
    return edges.join(gone, edges.to_qualified == gone.qualified_name, "left_anti").join(
        gone, edges.from_qualified == gone.qualified_name, "left_anti"
    )


def resolve_edges(raw_edges: DataFrame, symbols: DataFrame, resolve: str = "complete", bits: int = FILTER_BITS) -> DataFrame:
    """Raw edges whose two names both are symbols, without duplicates.

    ``complete`` looks at all symbols. ``as_indexed`` lets a file see only symbols of files that
    come no later in path order, as when files are stored one after the other.

    Most callees are no symbols (``len``, ``print``): a bitmap of ``bits`` over the names stops them in the stage that reads the statements, before any shuffle.
    """
    members = cut(membership(symbols.select("qualified_name"), "qualified_name", bits), "name-bits")
    raw_edges = may_be_in(raw_edges, "to_qualified", members, bits)
    # the callee name rarely exists, so that join goes first and leaves little for the second one
    if resolve == "complete":
        raw = raw_edges.select(*EDGE_KEY).distinct()
        names = symbols.select("qualified_name")
        found = raw.join(names, raw.to_qualified == names.qualified_name, "left_semi")
        return found.join(names, found.from_qualified == names.qualified_name, "left_semi")
    if resolve != "as_indexed":
        raise ValueError(f"unknown resolve mode {resolve!r}")
    seen_from = "visible_from" if "visible_from" in symbols.columns else "file_path"
    names = symbols.select("qualified_name", F.col(seen_from).alias("visible_from"))
    raw = raw_edges.select("file_path", *EDGE_KEY).distinct()
    in_time = names.visible_from <= raw.file_path
    found = raw.join(names, (raw.to_qualified == names.qualified_name) & in_time, "left_semi")
    found = found.join(names, (found.from_qualified == names.qualified_name) & in_time, "left_semi")
    return found.select(*EDGE_KEY).distinct()


def _edge_keys(*parts: DataFrame) -> DataFrame:
    """The distinct keys (``to_qualified``) of all rows of an edge table that a change may remove or add."""
    keys = reduce(DataFrame.union, [part.select(F.col(part.columns[0]).alias("key")) for part in parts])
    return cut(keys.distinct(), "edge-keys")


def _into(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Where the edges that start at one of ``names(qualified_name)`` lead."""
    sources = names.select(F.col("qualified_name").alias("from_qualified"))
    return semi_join_by_size(edges.select("from_qualified", "to_qualified"), sources, ["from_qualified"]).select("to_qualified")


def _ends(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("from_qualified").alias("qualified_name")).union(edges.select("to_qualified"))
    return cut(ends.distinct(), "asked-names")


def edges_again(
    edges: DataFrame, raw_edges: DataFrame, old_raw: DataFrame, new_raw: DataFrame, touched: DataFrame, known: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The change of the edges in ``complete`` mode: equal to resolving everything again, at the cost of the change.

    Only edges that touch a name of a changed file (``touched``), or that a changed file stated (``old_raw``) or states (``new_raw``), are worked out anew from
    ``raw_edges``, all statements after the change. ``known`` looks names up. Answers the keys of the change, and what it makes of old edges.
    """
    stated = cut(old_raw.select(*EDGE_KEY).union(new_raw.select(*EDGE_KEY)).distinct(), "touched-edges")
    mark = F.lit(True)
    at_target = touched.select(F.col("qualified_name").alias("to_qualified"), mark.alias("_to"))
    at_source = touched.select(F.col("qualified_name").alias("from_qualified"), mark.alias("_from"))
    marked = raw_edges.select(*EDGE_KEY).join(at_target, "to_qualified", "left").join(at_source, "from_qualified", "left")
    marked = marked.join(stated.withColumn("_stated", mark), EDGE_KEY, "left")
    again = cut(marked.filter("_to OR _from OR _stated").select(*EDGE_KEY).distinct(), "edges-again")
    names = cut(known(_ends(again)).select("qualified_name").distinct(), "known-names")
    added = again.join(names, again.to_qualified == names.qualified_name, "left_semi")
    added = cut(added.join(names, added.from_qualified == names.qualified_name, "left_semi"), "added-edges")
    keys = _edge_keys(touched, stated.select("to_qualified"), _into(edges, touched), added.select("to_qualified"))
    return keys, lambda old: cascade_edges(old, touched).join(stated, EDGE_KEY, "left_anti").select(*EDGE_KEY).unionByName(added)


def edges_again_in_order(
    edges: DataFrame, new_raw: DataFrame, removed: DataFrame, changed: DataFrame, known: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The change of the edges in ``as_indexed`` mode.

    Every edge that touches a name in ``removed`` (an old symbol of a changed file) is gone, also one from an unchanged file. A changed file sees the symbols of
    unchanged files, and of changed files no later in path order. Arguments and answer are otherwise those of ``edges_again``.
    """
    names = known(_ends(new_raw)).join(changed.withColumn("_changed", F.lit(True)), "file_path", "left")
    visible = names.withColumn("visible_from", F.when(F.col("_changed"), F.col("file_path")).otherwise(F.lit("")))
    added = cut(resolve_edges(new_raw, visible, "as_indexed"), "added-edges")
    keys = _edge_keys(removed, _into(edges, removed), added.select("to_qualified"))
    return keys, lambda old: cascade_edges(old, removed).select(*EDGE_KEY).unionByName(added).distinct()


def run_summary(scanned: DataFrame, handled: DataFrame) -> DataFrame:
    """Number of files looked at (of any type) and of files indexed (also those that did not parse)."""
    tagged = scanned.select(F.lit(1).alias("s"), F.lit(0).alias("i")).unionAll(
        handled.select(F.lit(0).alias("s"), F.lit(1).alias("i"))
    )
    return tagged.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("i"), F.lit(0)).alias("indexed")
    )
