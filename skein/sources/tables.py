"""Writing the graph tables as one version and reading the newest version back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("source_batch", T.LongType()),
        T.StructField("published", T.TimestampType()),
        T.StructField("feed", T.StringType()),
    ]
)

# Rows that a query looks up together lie together, so parquet statistics prune the scan. The second
# column splits a hot first one over several files.
CLUSTERED_BY = {"symbols": ("name", "qualified_name"), "edges": ("to_qualified", "from_qualified")}


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """One row per published version, oldest first by ``version``; empty before the first publish."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).parquet(f"{root}/pointer")


def current_version(spark: SparkSession, root: str) -> int | None:
    return pointers(spark, root).agg(F.max("version")).first()[0]


def publish(
    root: str, tables: Mapping[str, DataFrame], source_batch: int | None = None, cluster: bool = True, feed: str | None = None
) -> int:
    """Write all ``tables`` as the next version below ``root``; they become visible together.

    The data goes to a directory of its own and the pointer row is appended last, so a run that
    dies before leaves the readers on the version they had.
    """
    spark = next(iter(tables.values())).sparkSession
    version = (current_version(spark, root) or 0) + 1
    for name, df in tables.items():
        keys = CLUSTERED_BY.get(name) if cluster else None
        if keys:
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        df.write.mode("overwrite").parquet(f"{root}/v{version:08d}/{name}")
    row = spark.range(1).select(
        F.lit(version).cast("long").alias("version"),
        F.lit(source_batch).cast("long").alias("source_batch"),
        F.current_timestamp().alias("published"),
        F.lit(feed).cast("string").alias("feed"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published below {root}")
    return spark.read.parquet(f"{root}/v{version:08d}/{name}")
