"""Session settings, the shared scratch folder and the broadcast size check."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a bounded count shows it is below both limits.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def build_session(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # one row of the extraction stage is a whole source file
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` where the cluster sets it.

    Only a local-mode session (one JVM, no executors elsewhere) without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="skein-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/skein/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this package, once no DataFrame that reads them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/skein")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs a re-read and not a recomputation,
    and Catalyst sees the real size when it picks the next join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``rows`` rows and ``size`` bytes; reads at most ``rows + 1`` rows."""
    counted = df.limit(rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    ).first()
    return counted["n"] <= rows and (counted["bytes"] or 0) <= size


def semi_join_by_size(big: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Keep the rows of ``big`` whose key occurs in ``keys``: as a filter in the scan stage when ``keys`` is
    small, else by the join that Spark chooses."""
    return big.join(F.broadcast(keys) if fits_broadcast(keys) else keys, on, "left_semi")
