"""Index a corpus from scratch, and update an index with changed files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.extract import PYTHON, Extractor, extract, raw_edges_of, rejects_of, symbols_of
from skein.operators.maintain import (
    changed_files,
    dedupe_symbols,
    edges_again,
    edges_again_in_order,
    file_rows,
    lost_claims,
    owners,
    replace_by_file,
    resolve_edges,
    run_summary,
    settle_conflicts,
)
from skein.operators.name_index import change_of_grams, name_grams
from skein.operators.plugins import Plugin, apply_plugins
from skein.schemas import EDGES, FILES, RAW_EDGES, SYMBOLS, conform
from skein.session import cut, semi_join_by_size
from skein.sources.files import DEFAULT_EXCLUDE, dispatch, drop_excluded, restrict_to, scan_tree, with_hash, with_text
from skein.sources.store import BUCKETS, Change, current_version, publish, publish_changes, read_table, table_names

TABLES = ("files", "symbols", "names", "raw_edges", "edges")


@dataclass(frozen=True)
class Index:
    """The tables of a code graph. ``names`` (who owns a qualified name) follows from the symbols; ``grams`` is there if it was published.

    An index that was loaded knows its ``root`` and ``version``, one that was updated also its ``changes``, so publishing it costs what the change costs.
    """

    files: DataFrame
    symbols: DataFrame
    raw_edges: DataFrame
    edges: DataFrame
    names: DataFrame | None = None
    grams: DataFrame | None = None
    root: str | None = None
    version: int | None = None
    changes: Mapping[str, Change] | None = None

    def __post_init__(self) -> None:
        if self.names is None:
            object.__setattr__(self, "names", owners(self.symbols))

    def part(self, name: str, keys: DataFrame) -> DataFrame:
        """At least the rows of a table with one of ``keys(key)``: of a published one only the buckets these fall in."""
        if self.root is None or self.changes is not None:
            return getattr(self, name)
        return read_table(self.files.sparkSession, self.root, name, self.version, keys)

    def publish(
        self, root: str, source_batch: int | None = None, feed: str | None = None, buckets: int = BUCKETS, grams: bool = False
    ) -> int:
        """Write the tables as the next version below ``root``.

        An index that was loaded from this root and updated is published as a change of the version it came from: only buckets that hold a changed key are
        written, and ``ConcurrentPublish`` is raised if another run has published that next version. ``grams`` adds the table that substring search reads.
        """
        if self.changes is not None and root == self.root:
            return publish_changes(self.files.sparkSession, root, self.version, self.changes, source_batch, feed)
        tables = {name: getattr(self, name) for name in TABLES}
        if grams or self.grams is not None:
            tables["grams"] = name_grams(self.symbols) if self.grams is None else self.grams
        return publish(root, tables, source_batch, feed, buckets)


@dataclass(frozen=True)
class Parsed:
    """The outcome of the extraction stage for one set of files."""

    handled: DataFrame
    symbols: DataFrame
    raw_edges: DataFrame
    rejects: DataFrame


def load_index(spark: SparkSession, root: str) -> Index:
    version = current_version(spark, root)
    tables = {name: read_table(spark, root, name, version) for name in table_names(spark, root, version)}
    return Index(**tables, root=root, version=version)


def empty_index(spark: SparkSession) -> Index:
    return Index(*[spark.createDataFrame([], schema) for schema in (FILES, SYMBOLS, RAW_EDGES, EDGES)])


def handled_only(scan: DataFrame, extractors: Sequence[Extractor] = (PYTHON,)) -> DataFrame:
    path = F.col("file_path")
    return scan.filter(F.isnotnull(dispatch(path, [(e.name, e.accepts(path)) for e in extractors])))


def parse_files(
    hashed: DataFrame,
    plugins: Sequence[Plugin] = (),
    extractors: Sequence[Extractor] = (PYTHON,),
    strip_prefix: str | None = None,
) -> Parsed:
    """Extract ``file_path, content, content_hash`` once; the result is a table that all later steps read.

    Hashes come from that table too, so they are those of the bytes that were parsed.
    """
    stamped = with_text(hashed)
    extracted = extract(stamped, extractors, strip_prefix)
    extracted = cut(extracted, "extracted")
    symbols, raw_edges = apply_plugins(symbols_of(extracted), raw_edges_of(extracted), plugins)
    symbols = dedupe_symbols(symbols).withColumn("last_indexed", F.current_timestamp())
    handled = extracted.select("file_path", F.col("module").alias("module_path"), "content_hash")
    return Parsed(handled, conform(symbols, SYMBOLS), raw_edges.select(*RAW_EDGES.names), rejects_of(extracted))


def index_corpus(
    scan: DataFrame,
    listing: DataFrame | None = None,
    exclude: Sequence[str] | None = None,
    plugins: Sequence[Plugin] = (),
    extractors: Sequence[Extractor] = (PYTHON,),
    resolve: str = "complete",
    on_conflict: str = "error",
    strip_prefix: str | None = None,
) -> Index:
    """Index every handled file of ``scan`` (``file_path, content``) from scratch."""
    if listing is not None:
        scan = restrict_to(scan, listing)
    hashed = with_hash(handled_only(drop_excluded(scan, exclude), extractors))
    parsed = parse_files(hashed, plugins, extractors, strip_prefix)
    symbols = settle_conflicts(cut(parsed.symbols, "symbols"), on_conflict)
    edges = resolve_edges(parsed.raw_edges, symbols, resolve)
    return Index(file_rows(parsed.handled, symbols), symbols, parsed.raw_edges, edges)


def index_tree(
    spark: SparkSession, root: str, prefix: str | None = None, exclude: Sequence[str] | None = None, globs: Sequence[str] = ("*.py",), **options
) -> Index:
    """Index the files below ``root``: excluded directories are not entered, and only files that match ``globs`` are read.

    ``exclude`` is that of ``index_corpus`` and holds for the names that files get, ``prefix`` that of ``scan_tree``; ``options`` go to ``index_corpus``.
    """
    exclude = list(exclude or DEFAULT_EXCLUDE)
    scan = scan_tree(spark, root, prefix, globs=globs, exclude=exclude)
    return index_corpus(scan, exclude=exclude, **options)


def update_index(
    index: Index,
    scan: DataFrame,
    plugins: Sequence[Plugin] = (),
    extractors: Sequence[Extractor] = (PYTHON,),
    resolve: str = "complete",
    on_conflict: str = "error",
    strip_prefix: str | None = None,
    deleted: DataFrame | None = None,
) -> Index:
    """The index after the files of ``scan`` were looked at again.

    Unchanged content is skipped before parsing. No exclude list applies here. A file that is
    gone keeps its rows, unless its path is given in ``deleted``.

    What the change needs of the old tables is read by bucket; the tables themselves are only passed over where an edge of any file may touch a name of a
    changed one. The tables of the answer are whole; ``publish`` to the root that the index came from writes changed buckets only.
    """
    hashed = changed_files(with_hash(handled_only(scan, extractors)), index.files)
    parsed = parse_files(hashed, plugins, extractors, strip_prefix)
    new_symbols = cut(parsed.symbols, "new-symbols")
    new_raw = parsed.raw_edges
    gone = parsed.handled.select("file_path")
    if deleted is not None:
        gone = gone.unionByName(deleted.select("file_path")).distinct()
    gone = cut(gone, "gone-files")
    by_file = gone.select(F.col("file_path").alias("key"))

    old_symbols = semi_join_by_size(index.part("symbols", by_file).select("file_path", "qualified_name", "name"), gone, ["file_path"])
    old_symbols = cut(old_symbols, "old-symbols")
    touched = cut(old_symbols.select("qualified_name").union(new_symbols.select("qualified_name")).distinct(), "touched-names")
    by_name = touched.select(F.col("qualified_name").alias("key"))

    # only names of changed files can come into conflict
    claims = replace_by_file(index.part("names", by_name), gone, owners(new_symbols))
    lost = lost_claims(semi_join_by_size(claims, touched, ["qualified_name"]), on_conflict)

    def settled(rows: DataFrame) -> DataFrame:
        return rows if lost is None else rows.join(lost, ["qualified_name", "file_path"], "left_anti").select(*rows.columns)

    losers = by_file if lost is None else by_file.union(lost.select("file_path"))
    changes = {
        "files": Change(by_file, lambda old: replace_by_file(old, gone, file_rows(parsed.handled, new_symbols))),
        "symbols": Change(losers, lambda old: settled(replace_by_file(old, gone, new_symbols))),
        "names": Change(by_name, lambda old: settled(replace_by_file(old, gone, owners(new_symbols)))),
        "raw_edges": Change(by_file, lambda old: replace_by_file(old, gone, new_raw)),
    }

    def known(asked: DataFrame) -> DataFrame:
        """Names of the updated index among ``asked(qualified_name)``, with their files."""
        rows = changes["names"].apply(index.part("names", asked.select(F.col("qualified_name").alias("key"))))
        return semi_join_by_size(rows, asked, ["qualified_name"])

    if resolve == "complete":
        old_raw = semi_join_by_size(index.part("raw_edges", by_file), gone, ["file_path"])
        raw = changes["raw_edges"].apply(index.raw_edges)
        changes["edges"] = Change(*edges_again(index.edges, raw, old_raw, new_raw, touched, known))
    else:
        removed = old_symbols.select("qualified_name").distinct()
        changes["edges"] = Change(*edges_again_in_order(index.edges, new_raw, removed, gone, known))
    tables = {name: changes[name].apply(getattr(index, name)) for name in TABLES}
    grams = None
    if index.grams is not None:
        changes["grams"] = change_of_grams(old_symbols, new_symbols, tables["symbols"])
        grams = changes["grams"].apply(index.grams)
    tables["files"] = tables["files"].select(*FILES.names)
    return Index(**tables, grams=grams, root=index.root, version=index.version, changes=changes if index.root else None)


def update_summary(index: Index, scan: DataFrame, extractors: Sequence[Extractor] = (PYTHON,)) -> DataFrame:
    """Scanned and indexed counts of an update."""
    paths = with_hash(handled_only(scan, extractors)).select("file_path", "content_hash")
    return run_summary(scan.select("file_path"), changed_files(paths, index.files))
