"""Hooks between extraction and storing: re-tag symbols, add raw edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plugin:
    """``on_symbols`` maps the symbols; ``extra_edges`` derives raw edges from the symbols after that.

    Both see all files at once; ``file_path`` tells the files apart. ``on_symbols`` runs before de-duplication.
    """

    name: str
    on_symbols: Callable[[DataFrame], DataFrame] | None = None
    extra_edges: Callable[[DataFrame], DataFrame] | None = None


def apply_plugins(symbols: DataFrame, raw_edges: DataFrame, plugins: Sequence[Plugin]) -> tuple[DataFrame, DataFrame]:
    """Run the plugins in order; each one sees what those before it made of the symbols."""
    for plugin in plugins:
        if plugin.on_symbols:
            symbols = symbols.transform(plugin.on_symbols)
        if plugin.extra_edges:
            raw_edges = raw_edges.unionByName(symbols.transform(plugin.extra_edges).select(*raw_edges.columns))
    return symbols, raw_edges


def web_kind(kind: Column, path: Column) -> Column:
    """``model`` for classes in a models file, ``view`` for classes and functions in a views file."""
    models, views = F.contains(path, F.lit("models.py")), F.contains(path, F.lit("views.py"))
    return (
        F.when((kind == "class") & models, "model")
        .when(kind.isin("class", "function") & views, "view")
        .otherwise(kind)
    )


WEB = Plugin("web", lambda symbols: symbols.withColumn("kind", web_kind(F.col("kind"), F.col("file_path"))))
