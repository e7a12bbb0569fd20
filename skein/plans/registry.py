"""The registered queries: each runs an operator over whole tables given by the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.paths import module_path
from skein.operators import extract as ex
from skein.operators import maintain as mt
from skein.operators.context import file_head, line_context
from skein.operators.grep import grep, grep_requests
from skein.operators.name_index import name_grams
from skein.operators.plugins import WEB, apply_plugins
from skein.operators.semantic import search_semantic
from skein.operators.shortest_path import path_between
from skein.operators.summary import file_summary, graph_stats, stats_by_language, symbols_by_kind, touches_model
from skein.operators.symbol_search import display, search_exact, search_substring, search_symbol
from skein.operators.usages import find_usages, graph_usages
from skein.plans.derived import code_corpus, entity_edges, entity_files, entity_symbols, load, text_files
from skein.plans.indexing import Index, handled_only, index_corpus, load_index, update_index, update_summary
from skein.schemas import RAW_EDGES
from skein.session import cut, scratch_path
from skein.sources.files import dispatch, drop_excluded, from_table, prune_walk, restrict_to, with_hash, with_text
from skein.sources.lines import numbered_lines
from skein.streaming.feed import apply_versions, latest_versions, run_feed
from skein.sources.store import publish, read_table

Query = Callable[[SparkSession, str], DataFrame]

HIT = ["request_id", "qualified_name", "kind", "file_path", "line_start", "summary", "source"]
SYMBOL_COLUMNS = ["name", "qualified_name", "kind", "file_path", "line_start", "line_end", "summary", "ordinal"]


def _requests(*parts: tuple[str, DataFrame, Column, str | None]) -> DataFrame:
    """Requests from table columns: (id prefix, table, asked text, kind). Equal texts are asked once per prefix."""
    made = [
        df.select(F.concat(F.lit(prefix + " "), name).alias("request_id"), name.alias("name"), F.lit(kind).cast("string").alias("kind")).distinct()
        for prefix, df, name, kind in parts
    ]
    return reduce(DataFrame.unionByName, made)


def _words(df: DataFrame, column: str) -> DataFrame:
    """``word``: all distinct words of a text column."""
    return df.select(F.explode(F.regexp_extract_all(column, F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()


# ---- symbol search ------------------------------------------------------------------------------


def exact_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(
        ("nation", load(spark, sf, "nation"), F.col("n_name"), None),
        ("region", load(spark, sf, "region"), F.col("r_name"), ""),
        ("priority", load(spark, sf, "orders"), F.col("o_orderpriority"), None),
        ("part", load(spark, sf, "part"), F.col("p_name"), None),
    )


def symbol_exact(spark: SparkSession, sf: str) -> DataFrame:
    return search_exact(entity_symbols(spark, sf), exact_requests(spark, sf)).select(*HIT)


def substring_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(
        ("nation", load(spark, sf, "nation"), F.lower("n_name"), None),
        ("region", load(spark, sf, "region"), F.lower("r_name"), None),
        ("priority", load(spark, sf, "orders"), F.lower("o_orderpriority"), None),
        ("word", _words(load(spark, sf, "part"), "p_name"), F.col("word"), None),
        ("pattern", load(spark, sf, "nation"), F.concat(F.lit("_us%#%"), F.col("n_nationkey").cast("string")), None),
    )


def symbol_substring(spark: SparkSession, sf: str) -> DataFrame:
    return search_substring(entity_symbols(spark, sf), substring_requests(spark, sf)).select(*HIT)


def symbol_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The requests of ``symbol_substring``, and some of one or two characters and of wildcards only, from published posting lists."""
    symbols = entity_symbols(spark, sf)
    root = scratch_path(spark, "postings")
    publish(root, {"grams": name_grams(symbols)}, buckets=8)
    nation, segment = load(spark, sf, "nation"), load(spark, sf, "customer")
    short = _requests(
        ("two", nation, F.lower(F.substr("n_name", F.lit(1), F.lit(2))), None),
        ("one", segment, F.lower(F.substr("c_mktsegment", F.lit(1), F.lit(1))), "view"),
        ("any", segment, F.regexp_replace("c_mktsegment", ".", "_"), "model"),
        ("all", load(spark, sf, "region"), F.regexp_replace("r_name", ".+", "%"), "class"),
    )
    asked = substring_requests(spark, sf).unionByName(short)
    return search_substring(symbols, asked, postings=read_table(spark, root, "grams")).select(*HIT)


def symbol_substring_literal(spark: SparkSession, sf: str) -> DataFrame:
    found = search_substring(entity_symbols(spark, sf), substring_requests(spark, sf), wildcards=False)
    return found.select(*HIT)


def kind_requests(spark: SparkSession, sf: str) -> DataFrame:
    nation, part, customer = (load(spark, sf, t) for t in ("nation", "part", "customer"))
    words = _words(part, "p_name")
    return _requests(
        ("model", nation, F.col("n_name"), "model"),
        ("no view", nation, F.col("n_name"), "view"),
        ("import", words, F.col("word"), "import"),
        ("no model", words, F.col("word"), "model"),
        ("view", customer, F.lower("c_name"), "view"),
    )


def symbol_kind(spark: SparkSession, sf: str) -> DataFrame:
    return search_symbol(entity_symbols(spark, sf), kind_requests(spark, sf)).select(*HIT)


def tiered_requests(spark: SparkSession, sf: str) -> DataFrame:
    nation, part = load(spark, sf, "nation"), load(spark, sf, "part")
    return _requests(
        ("exact", nation, F.col("n_name"), None),
        ("hot", load(spark, sf, "orders"), F.col("o_orderpriority"), None),
        ("substring", _words(part, "p_name"), F.col("word"), None),
        ("text", _words(load(spark, sf, "benchmark"), "text"), F.col("word"), "model"),
    )


def symbol_tiered(spark: SparkSession, sf: str) -> DataFrame:
    hits = search_symbol(entity_symbols(spark, sf), tiered_requests(spark, sf), text_files(spark, sf))
    return hits.select(*HIT, "match_text")


def hit_display(spark: SparkSession, sf: str) -> DataFrame:
    symbols = entity_symbols(spark, sf)
    found = display(search_exact(symbols, exact_requests(spark, sf)))
    usages = display(graph_usages(symbols, entity_edges(spark, sf), target_requests(spark, sf)))
    return found.unionByName(usages)


# ---- usages and summaries -----------------------------------------------------------------------


def target_requests(spark: SparkSession, sf: str) -> DataFrame:
    return entity_symbols(spark, sf).select(F.col("qualified_name").alias("request_id"), "qualified_name")


def usages(spark: SparkSession, sf: str) -> DataFrame:
    found = graph_usages(entity_symbols(spark, sf), entity_edges(spark, sf), target_requests(spark, sf))
    return found.drop("match_text")


def usages_fallback(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(load(spark, sf, "benchmark"), "text")
    unknown = words.select(F.concat(F.lit("passage."), F.col("word")).alias("qualified_name"))
    known = load(spark, sf, "nation").select(F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")).alias("qualified_name"))
    asked = unknown.unionByName(known).withColumn("request_id", F.col("qualified_name"))
    return find_usages(entity_symbols(spark, sf), entity_edges(spark, sf), asked, text_files(spark, sf))


def summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    return file_summary(entity_files(spark, sf), entity_symbols(spark, sf))


def head_rows(spark: SparkSession, sf: str) -> DataFrame:
    files = text_files(spark, sf)
    lost = load(spark, sf, "labels").select(F.concat(F.lit("lost/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"))
    asked = files.select("file_path").unionByName(lost)
    indexed = handled_only(files).select("file_path")
    return file_head(files, indexed, asked).withColumn("head", F.array_join("head", "\n"))


def touched_models(spark: SparkSession, sf: str) -> DataFrame:
    asked = load(spark, sf, "nation").select(F.col("n_name").alias("request_id"), F.col("n_name").alias("model_name"))
    return touches_model(entity_symbols(spark, sf), cut(entity_edges(spark, sf), "entity-edges"), asked)


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph_stats(entity_files(spark, sf), entity_symbols(spark, sf), entity_edges(spark, sf))


def stats_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return symbols_by_kind(entity_symbols(spark, sf))


def language_stats(spark: SparkSession, sf: str) -> DataFrame:
    lines = numbered_lines(text_files(spark, sf))
    return stats_by_language(lines.select("file_path"))


# ---- text ---------------------------------------------------------------------------------------


def corpus_lines(spark: SparkSession, sf: str) -> DataFrame:
    return numbered_lines(text_files(spark, sf))


def context_requests(spark: SparkSession, sf: str) -> DataFrame:
    files = text_files(spark, sf)

    def ask(prefix: str, line: Column, radius: Column) -> DataFrame:
        return files.select(
            F.concat(F.lit(prefix), F.col("file_path")).alias("request_id"), "file_path", line.cast("int").alias("line"), radius.cast("int").alias("radius")
        )

    lost = load(spark, sf, "labels").select(
        F.concat(F.lit("lost "), F.col("doc_id").cast("string")).alias("request_id"),
        F.concat(F.lit("lost/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.lit(1).alias("line"),
        F.lit(None).cast("int").alias("radius"),
    )
    by_size = F.floor(F.char_length("text") / 400)
    parts = [
        ask("first ", F.lit(1), F.lit(0)),
        ask("third ", F.lit(3), F.lit(2)),
        ask("deep ", by_size, F.lit(4)),
        ask("beyond ", F.lit(1_000_000), F.lit(None)),
        lost,
    ]
    return reduce(DataFrame.unionByName, parts)


def context_rows(spark: SparkSession, sf: str) -> DataFrame:
    return line_context(text_files(spark, sf), context_requests(spark, sf))


def grep_lines(spark: SparkSession, sf: str) -> DataFrame:
    return grep(text_files(spark, sf), "[aeiou]{3}n[a-z]*(tion|ing)", limit=None)


def grep_first(spark: SparkSession, sf: str) -> DataFrame:
    return grep(text_files(spark, sf), "tion")


def grep_basic(spark: SparkSession, sf: str) -> DataFrame:
    return grep(text_files(spark, sf), r"^The*\(re\|nd\)\{1,2\}[[:lower:]]* ", limit=None, dialect="basic")


def grep_include_exclude(spark: SparkSession, sf: str) -> DataFrame:
    files = text_files(spark, sf)
    return grep(files, "(ing|ment)[.,]", ["*.py", "page_?.html"], ["f[qr]", "src1*"], limit=None)


def grep_many(spark: SparkSession, sf: str) -> DataFrame:
    asked = _words(load(spark, sf, "benchmark"), "text").select(F.concat(F.lit("word "), F.col("word")).alias("request_id"), F.col("word").alias("pattern"))
    return grep_requests(text_files(spark, sf), asked, limit=20, dialect="basic")


def grep_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """An expression for each distinct word: the word at the start of a line or before a comma, and one that has no text of its own."""
    words = _words(load(spark, sf, "benchmark"), "text")
    forms = [F.concat(F.lit("^"), F.col("word"), F.lit(" ")), F.concat(F.col("word"), F.lit("[,;] [a-z]*"))]
    asked = words.select(F.explode(F.array(*forms)).alias("pattern")).unionByName(spark.range(1).select(F.lit("[A-Z][0-9]").alias("pattern")))
    asked = asked.withColumn("request_id", F.col("pattern"))
    return grep_requests(text_files(spark, sf), asked, limit=5, dialect="basic")


# ---- scan ---------------------------------------------------------------------------------------


def url_scan(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages")
    return pages.select(F.col("url").alias("file_path"), "page_id")


def listing_scan(spark: SparkSession, sf: str) -> DataFrame:
    listing = load(spark, sf, "labels").select(
        F.explode(
            F.array(*[F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(f".{e}")) for e in ("py", "js", "md", "html")])
        ).alias("file_path")
    )
    files = text_files(spark, sf).withColumn("file_path", F.element_at(F.split("file_path", "/"), -1))
    return restrict_to(files, listing).select("file_path", F.char_length("text").alias("n_chars"))


def tree_prune(spark: SparkSession, sf: str) -> DataFrame:
    return prune_walk(url_scan(spark, sf), ["fr", "es"])


def exclude_filter(spark: SparkSession, sf: str) -> DataFrame:
    return drop_excluded(url_scan(spark, sf), [".net", "/fr/", "?page"])


def exclude_defaults(spark: SparkSession, sf: str) -> DataFrame:
    names = load(spark, sf, "customer").select(
        F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit("/"), F.lower("c_mktsegment"), F.lit(".py")).alias("file_path")
    )
    return drop_excluded(names)


def handler_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("file_path")
    handlers = [("python", F.endswith(path, F.lit(".py"))), ("web", F.rlike(path, F.lit(r"\.(js|html)$")))]
    return text_files(spark, sf).select("file_path", dispatch(path, handlers).alias("handler"))


def module_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = text_files(spark, sf).select("file_path").unionByName(url_scan(spark, sf).select("file_path"))
    return paths.select("file_path", module_path(F.col("file_path")).alias("module_path"))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return with_hash(from_table(text_files(spark, sf), "file_path", "text")).select("file_path", "content_hash")


# ---- extraction and maintenance -----------------------------------------------------------------


def _extracted(spark: SparkSession, sf: str, version: int = 1) -> DataFrame:
    return ex.extract(with_text(code_corpus(spark, sf, version)))


def extract_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return ex.symbols_of(_extracted(spark, sf)).select(
        *SYMBOL_COLUMNS, F.col("extra.module").alias("module"), F.col("extra.original_name").alias("original_name")
    )


def extract_edges(spark: SparkSession, sf: str) -> DataFrame:
    return ex.raw_edges_of(_extracted(spark, sf))


def extract_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return ex.rejects_of(_extracted(spark, sf))


def retag_kinds(spark: SparkSession, sf: str) -> DataFrame:
    symbols = entity_symbols(spark, sf)
    path = F.col("file_path")
    tail = (
        F.when(F.startswith(path, F.lit("nation_1")), "/models.py")
        .when(F.startswith(path, F.lit("nation_2")), "/views.py")
        .otherwise("/urls.py")
    )
    symbols = symbols.withColumn("file_path", F.concat(path, tail))
    symbols, _ = apply_plugins(symbols, spark.createDataFrame([], RAW_EDGES), [WEB])
    return symbols.select("qualified_name", "file_path", "kind")


def symbols_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Entities named by ``name`` alone, so that names repeat within and across files."""
    return entity_symbols(spark, sf).withColumn("qualified_name", F.col("name"))


def dedupe_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return mt.dedupe_symbols(symbols_by_name(spark, sf)).select("file_path", "qualified_name", "ordinal", "kind")


def name_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return mt.name_conflicts(symbols_by_name(spark, sf))


def resolve_edges(spark: SparkSession, sf: str) -> DataFrame:
    return index_corpus(code_corpus(spark, sf)).edges


def resolve_as_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return index_corpus(code_corpus(spark, sf), resolve="as_indexed").edges


def _published(spark: SparkSession, sf: str, resolve: str = "complete") -> Index:
    root = scratch_path(spark, "index")
    index_corpus(code_corpus(spark, sf), resolve=resolve).publish(root)
    return load_index(spark, root)


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    before = with_hash(handled_only(code_corpus(spark, sf))).select("file_path", "content_hash")
    after = with_hash(handled_only(code_corpus(spark, sf, 2)))
    return mt.changed_files(after, before).select("file_path", "content_hash")


def _updated(spark: SparkSession, sf: str, resolve: str = "complete") -> Index:
    """A published index, updated with version 2 of the corpus, published as a change and read back."""
    before = _published(spark, sf, resolve)
    update_index(before, code_corpus(spark, sf, 2), resolve=resolve).publish(before.root)
    return load_index(spark, before.root)


def upsert_files(spark: SparkSession, sf: str) -> DataFrame:
    return _updated(spark, sf).files.select("file_path", "module_path", "symbol_count", "content_hash")


def replace_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _updated(spark, sf).symbols.select(*SYMBOL_COLUMNS)


def update_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _updated(spark, sf).edges


def cascade_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _updated(spark, sf, "as_indexed").edges


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return update_summary(index_corpus(code_corpus(spark, sf)), code_corpus(spark, sf, 2))


# ---- paths and vectors --------------------------------------------------------------------------


def _shown_path(found: DataFrame) -> DataFrame:
    steps = F.transform("path", lambda s: F.concat(s["symbol"], F.lit(" "), s["relation"]))
    return found.select("request_id", F.array_join(steps, " > ").alias("path"))


def _named(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _to_one(df: DataFrame, prefix: str, key: str, target: str) -> DataFrame:
    source = F.concat(F.lit(prefix), F.col(key).cast("string"))
    return df.select(source.alias("request_id"), source.alias("from_qualified"), F.lit(target).alias("to_qualified"))


def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    asked = _to_one(load(spark, sf, "customer"), "customer.", "c_custkey", "region.0").unionByName(
        _to_one(load(spark, sf, "supplier"), "supplier.", "s_suppkey", "region.0")
    )
    asked = asked.unionByName(_to_one(load(spark, sf, "region"), "planet.", "r_regionkey", "region.0"))
    edges = cut(entity_edges(spark, sf), "entity-edges")
    return _shown_path(path_between(entity_symbols(spark, sf), edges, asked, max_depth=3))


def shortest_cycle(spark: SparkSession, sf: str) -> DataFrame:
    node = F.concat(F.lit("supplier."), F.col("s_suppkey").cast("string"))
    asked = load(spark, sf, "supplier").select(node.alias("request_id"), node.alias("from_qualified"), node.alias("to_qualified"))
    edges = cut(entity_edges(spark, sf), "entity-edges")
    return _shown_path(path_between(entity_symbols(spark, sf), edges, asked, max_depth=3))


def deep_requests(spark: SparkSession, sf: str) -> DataFrame:
    """From every part to the nation of the customer of that number, from every supplier to the next one, and to a customer, where nothing leads."""
    customer, supplier = load(spark, sf, "customer"), load(spark, sf, "supplier")
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("c_custkey"))
    home = part.join(customer.select("c_custkey", "c_nationkey"), "c_custkey")
    ends = [
        home.select(_named("part.", "c_custkey").alias("from_qualified"), _named("nation.", "c_nationkey").alias("to_qualified")),
        supplier.select(_named("supplier.", "s_suppkey").alias("from_qualified"), F.concat(F.lit("supplier."), (F.col("s_suppkey") + 1).cast("string"))),
        supplier.select(_named("supplier.", "s_suppkey").alias("from_qualified"), _named("customer.", "s_suppkey")),
    ]
    asked = reduce(DataFrame.union, ends)
    return asked.select(F.concat_ws(" to ", "from_qualified", "to_qualified").alias("request_id"), "from_qualified", "to_qualified")


def shortest_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the default depth; some requests have an end that cannot be reached or is not known."""
    edges = cut(entity_edges(spark, sf), "entity-edges")
    return _shown_path(path_between(entity_symbols(spark, sf), edges, deep_requests(spark, sf)))


def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = load(spark, sf, "embeddings")
    per_dim = vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # one row per dimension: a group has as many rows as a vector has elements
    centre = per_dim.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("all"))
    queries = centre.select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("request_id"), F.col("all.x").alias("embedding"))
    found = search_semantic(vectors, queries)
    return found.select("request_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# ---- change feed --------------------------------------------------------------------------------


def _as_versions(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("file_path"),
        F.concat("event_type", "props").alias("content"),
        "ts",
        "event_id",
    )


def feed_update(spark: SparkSession, sf: str) -> DataFrame:
    schema = load(spark, sf, "events").schema
    # as a glob the feed may be one file or a directory of them
    changes = _as_versions(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))
    root = scratch_path(spark, "feed")
    run_feed(changes, apply_versions(root, ["ts", "event_id"]), f"{root}/progress")
    return read_table(spark, root, "versions").select("file_path", "content", "event_id")


def feed_batch(spark: SparkSession, sf: str) -> DataFrame:
    return latest_versions(_as_versions(load(spark, sf, "events")), ["ts", "event_id"]).select(
        "file_path", "content", "event_id"
    )


QUERIES: dict[str, Query] = {
    "symbol_exact": symbol_exact,
    "symbol_substring": symbol_substring,
    "symbol_indexed": symbol_indexed,
    "symbol_substring_literal": symbol_substring_literal,
    "symbol_kind": symbol_kind,
    "symbol_tiered": symbol_tiered,
    "hit_display": hit_display,
    "usages": usages,
    "usages_fallback": usages_fallback,
    "file_summary": summary_rows,
    "file_head": head_rows,
    "touches_model": touched_models,
    "graph_stats": stats,
    "stats_by_kind": stats_by_kind,
    "stats_by_language": language_stats,
    "corpus_lines": corpus_lines,
    "line_context": context_rows,
    "grep_lines": grep_lines,
    "grep_first": grep_first,
    "grep_basic": grep_basic,
    "grep_include_exclude": grep_include_exclude,
    "grep_many": grep_many,
    "grep_expressions": grep_expressions,
    "listing_scan": listing_scan,
    "tree_prune": tree_prune,
    "exclude_filter": exclude_filter,
    "exclude_defaults": exclude_defaults,
    "handler_dispatch": handler_dispatch,
    "module_path": module_paths,
    "content_hash": content_hash,
    "extract_symbols": extract_symbols,
    "extract_edges": extract_edges,
    "extract_rejects": extract_rejects,
    "retag_kinds": retag_kinds,
    "dedupe_symbols": dedupe_symbols,
    "name_conflicts": name_conflicts,
    "resolve_edges": resolve_edges,
    "resolve_as_indexed": resolve_as_indexed,
    "changed_files": changed_files,
    "upsert_files": upsert_files,
    "replace_symbols": replace_symbols,
    "update_edges": update_edges,
    "cascade_edges": cascade_edges,
    "run_summary": run_summary,
    "shortest_paths": shortest_paths,
    "shortest_cycle": shortest_cycle,
    "shortest_deep": shortest_deep,
    "semantic_topk": semantic_topk,
    "feed_update": feed_update,
    "feed_batch": feed_batch,
}
