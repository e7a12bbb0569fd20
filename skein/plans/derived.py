"""Graphs and corpora that Spark derives from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.functions.paths import module_path
from skein.operators.maintain import EDGE_KEY

# Customers of one generated source file come from one block of keys, so a file stays small.
CUSTOMERS_PER_BLOCK = 200


_SCHEMAS: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footers once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# ---- the entity graph -------------------------------------------------------------------------


def entity_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers, customers, parts and orders as symbols."""

    def part(table: str, key: str, name: str, prefix: str, kind: Column, path: Column) -> DataFrame:
        return load(spark, sf_dir, table).select(
            F.col(name).alias("name"),
            _key(prefix, key).alias("qualified_name"),
            kind.alias("kind"),
            path.alias("file_path"),
            (F.col(key) % 1000).cast("int").alias("line_start"),
            F.concat(F.lit(f"{table} "), F.col(name)).alias("summary"),
            F.col(key).cast("long").alias("ordinal"),
        )

    customer_kind = F.when(F.col("c_custkey") % 10 == 0, "view").otherwise("function")
    parts = [
        part("region", "r_regionkey", "r_name", "region.", F.lit("file"), F.lit("region")),
        part("nation", "n_nationkey", "n_name", "nation.", F.lit("model"), _key("nation_", "n_nationkey")),
        part("supplier", "s_suppkey", "s_name", "supplier.", F.lit("class"), _key("nation_", "s_nationkey")),
        part("customer", "c_custkey", "c_name", "customer.", customer_kind, _key("nation_", "c_nationkey")),
        part("part", "p_partkey", "p_name", "part.", F.lit("import"), _key("brand_", "p_brand")),
        part("orders", "o_orderkey", "o_orderpriority", "order.", F.lit("method"), F.lit("orders")),
    ]
    return reduce(DataFrame.unionByName, parts)


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who orders, supplies and belongs where, as labelled edges without duplicates."""

    def edge(df: DataFrame, source: Column, target: Column, relation: Column) -> DataFrame:
        return df.select(source.alias(EDGE_KEY[0]), target.alias(EDGE_KEY[1]), relation.alias(EDGE_KEY[2]))

    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    supplier, nation = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    lineitem = load(spark, sf_dir, "lineitem")
    bought = lineitem.select("l_orderkey", "l_partkey").distinct()
    supplied = lineitem.select("l_suppkey", "l_partkey").distinct()
    both_ways = F.array(F.struct(_key("supplier.", "l_suppkey"), _key("part.", "l_partkey")), F.struct(_key("part.", "l_partkey"), _key("supplier.", "l_suppkey")))
    supplies = supplied.select(F.inline(both_ways).alias("a", "b"))
    by_segment = (
        F.when(F.col("c_mktsegment") == "BUILDING", "registers")
        .when(F.col("c_mktsegment") == "MACHINERY", "handles_signal")
        .otherwise("references")
    )
    part, order = _key("part.", "l_partkey"), _key("order.", "l_orderkey")
    edges = [
        edge(orders, _key("order.", "o_orderkey"), _key("customer.", "o_custkey"), F.lit("calls")),
        edge(bought, order, part, F.lit("references")),
        edge(supplies, F.col("a"), F.col("b"), F.lit("calls")),
        edge(customer, _key("customer.", "c_custkey"), _key("nation.", "c_nationkey"), by_segment),
        edge(supplier, _key("supplier.", "s_suppkey"), _key("nation.", "s_nationkey"), F.lit("inherits")),
        edge(nation, _key("nation.", "n_nationkey"), _key("region.", "n_regionkey"), F.lit("imports")),
    ]
    return reduce(DataFrame.unionByName, edges)


def entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One files row per path of the entity graph, the orders file included."""
    symbols = entity_symbols(spark, sf_dir)
    counts = symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("symbol_count"))
    return counts.select(
        "file_path", module_path(F.col("file_path")).alias("module_path"), F.lit(None).cast("string").alias("summary"), "symbol_count"
    )


# ---- the text corpus --------------------------------------------------------------------------


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, conversation turns and web pages as ``file_path, text``."""
    suffix = F.element_at(F.array(*[F.lit(e) for e in ("py", "js", "md", "html")]), (F.col("doc_id") % 4 + 1).cast("int"))
    documents = load(spark, sf_dir, "documents").select(
        F.concat(
            F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), suffix
        ).alias("file_path"),
        "text",
    )
    turns = load(spark, sf_dir, "conversations").select(
        F.concat(
            _key("conv_", "conv_id"), F.lit("/turn_"), F.col("turn").cast("string"), F.lit(".txt")
        ).alias("file_path"),
        "text",
    )
    pages = load(spark, sf_dir, "pages").select(
        F.concat(_key("pages/page_", "page_id"), F.lit(".html")).alias("file_path"), F.col("html").alias("text")
    )
    return documents.unionByName(turns).unionByName(pages)


# ---- the generated code corpus ----------------------------------------------------------------


def code_corpus(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """Python sources with one file per nation and block of customers: ``file_path, content``.

    Version 2 rewrites the class docstring of the nations of region AFRICA, drops their customers of
    segment BUILDING, adds a comment to ``shop/base.py`` and adds ``shop/extra.py``.
    """
    region, nation = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    customer = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    moved = F.lit(False)
    if version == 2:
        customer = customer.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        moved = F.col("r_name") == "AFRICA"
        customer = customer.filter(~(moved & (F.col("c_mktsegment") == "BUILDING")))

    n, c, r = (F.col(k).cast("string") for k in ("c_nationkey", "c_custkey", "n_regionkey"))
    body = F.concat(
        F.lit("def customer_"), c, F.lit("(x):\n    \"\"\"Customer "), c, F.lit(".\"\"\"\n    return Nation"), n, F.lit("().greet()\n\n")
    )
    head = F.concat(
        F.lit("import shop.base\nfrom shop.region_"), r, F.lit(" import Region"), r, F.lit(" as Parent\n\nclass Nation"), n,
        F.lit("(Parent):\n    \"\"\""), F.col("n_name"), F.when(moved, F.lit(" renewed")).otherwise(F.lit("")),
        F.lit(" entity.\"\"\"\n    def greet(self):\n        return shop.base.helper()\n\n"),
    )
    block = F.floor(F.col("c_custkey") / CUSTOMERS_PER_BLOCK)
    # customer keys are unique, so a group holds at most CUSTOMERS_PER_BLOCK rows
    grouped = customer.select("c_nationkey", block.alias("block"), "c_custkey", head.alias("head"), body.alias("body"))
    grouped = grouped.groupBy("c_nationkey", "block").agg(
        F.first("head").alias("head"), F.sort_array(F.collect_list(F.struct("c_custkey", "body"))).alias("bodies")
    )
    nations = grouped.select(
        F.concat(_key("shop/nation_", "c_nationkey"), F.lit("_"), F.col("block").cast("string"), F.lit(".py")).alias("file_path"),
        F.concat("head", F.array_join(F.col("bodies.body"), "")).alias("content"),
    )
    regions = region.select(
        F.concat(_key("shop/region_", "r_regionkey"), F.lit(".py")).alias("file_path"),
        F.concat(
            F.lit("import shop.base\nclass Region"), F.col("r_regionkey").cast("string"), F.lit("(shop.base.Missing):\n    \"\"\""), F.col("r_name"), F.lit(".\"\"\"\n")
        ).alias("content"),
    )
    drafts = nation.select(
        F.concat(_key("shop/draft_", "n_nationkey"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("class "), F.col("n_name"), F.lit("(:\n")).alias("content"),
    )
    notes = nation.select(
        F.concat(_key("shop/note_", "n_nationkey"), F.lit(".md")).alias("file_path"), F.col("n_name").alias("content")
    )
    base = "def helper():\n    return 1\n" if version == 1 else "# shared\ndef helper():\n    return 1\n"
    single = {"shop/base.py": base}
    if version == 2:
        single["shop/extra.py"] = "import shop.base\n"
    fixed = [
        spark.range(1).select(F.lit(path).alias("file_path"), F.lit(text).alias("content"))
        for path, text in single.items()
    ]
    files = reduce(DataFrame.unionByName, [nations, regions, drafts, notes, *fixed])
    return files.select("file_path", F.col("content").cast("binary").alias("content"))
