"""What a file holds, what touches a model, and counts of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.paths import extension
from skein.functions.skew import salted_join
from skein.session import cut, semi_join_by_size

# The kinds a file summary lists, and the list each one goes to.
SECTIONS = {"class": "classes", "function": "functions", "import": "imports"}


def file_summary(files: DataFrame, symbols: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """The classes, functions and imports of indexed files, as one row per listed name.

    Answers ``file_path, module_path, summary, section, ordinal, name, source``, in ``ordinal`` order
    within a section. A file that lists nothing has one row without section and name. Long rows
    instead of three lists: a file of any size stays spread over tasks. ``requests`` (``file_path``)
    narrows the answer; for a path that is not indexed see ``file_head``.
    """
    known = files.select("file_path", "module_path", "summary")
    listed = symbols.filter(F.col("kind").isin(*SECTIONS)).select("file_path", "kind", "ordinal", "name")
    if requests is not None:
        paths = cut(requests.select("file_path").distinct(), "summary-requests")
        known = known.join(paths, "file_path", "left_semi")
        listed = semi_join_by_size(listed, paths, ["file_path"])
    section = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(name)) for kind, name in SECTIONS.items()])
    rows = listed.join(known, "file_path").select(
        "file_path", "module_path", "summary", section.alias("section"), "ordinal", "name"
    )
    bare = known.join(listed.select("file_path").distinct(), "file_path", "left_anti")
    return rows.unionByName(bare, allowMissingColumns=True).withColumn("source", F.lit("graph"))


def touches_model(symbols: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """What points at the models named in ``requests`` (``request_id, model_name``), by bucket.

    Views go to ``views``; other users by relation to ``admin``, ``signals`` or ``references``.
    One row per user and relation: ``request_id, bucket, qualified_name, relation``. A model with a large
    share of all edges is spread over tasks.
    """
    names = requests.select(F.col("model_name").alias("name")).distinct()
    models = symbols.filter(F.col("kind") == "model").join(names, "name", "left_semi")
    models = cut(models.select("name", F.col("qualified_name").alias("to_qualified")), "models")
    users = symbols.select(F.col("qualified_name").alias("from_qualified"), F.col("kind").alias("user_kind"))
    bucket = (
        F.when(F.col("user_kind") == "view", "views")
        .when(F.col("relation") == "registers", "admin")
        .when(F.col("relation") == "handles_signal", "signals")
        .otherwise("references")
    )
    into = edges.select("from_qualified", "to_qualified", "relation")
    touching = (
        salted_join(into, models, "to_qualified")
        .join(users, "from_qualified")
        .select("name", bucket.alias("bucket"), F.col("from_qualified").alias("qualified_name"), "relation")
        .distinct()
    )
    asked = requests.select("request_id", F.col("model_name").alias("name"))
    return salted_join(cut(touching, "model-users"), asked, "name").select("request_id", "bucket", "qualified_name", "relation")


def graph_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the number of files, symbols and edges."""
    tables = {"files": files, "symbols": symbols, "edges": edges}
    counts = None
    for name, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias("n")).select(
            *[(F.col("n") if other == name else F.lit(0).cast("long")).alias(other) for other in tables]
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.sum(name).alias(name) for name in tables])


def symbols_by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n_symbols"))


def stats_by_language(symbols: DataFrame) -> DataFrame:
    """Files and symbols per file extension."""
    per_file = symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(extension(F.col("file_path")).alias("extension")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_symbols")
    )
