"""Published versions of the graph tables, kept in hash buckets so that an update writes only the buckets it touches.

Below a root there are

* ``data/<table>/<write>/bucket=<k>/``: the rows of one bucket, written once and never changed;
* ``manifest/<write>/``: which directory holds each bucket of each table, and the schemas;
* ``versions/v<version>.json``: a marker that names the manifest, created only if it is not there yet. A version exists when its marker does.

A version takes over the directories of all buckets that did not change. A run that dies before its marker leaves the readers on the version they had, and of two
writers that start from one version only the first can finish.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16

# The column whose hash gives the bucket, and how rows lie within a bucket. What a query looks up together lies together, so Parquet statistics prune the scan.
KEYS = {
    "files": ("file_path", ["file_path"]),
    "symbols": ("file_path", ["name", "qualified_name"]),
    "names": ("qualified_name", ["qualified_name"]),
    "raw_edges": ("file_path", ["to_qualified"]),
    "edges": ("to_qualified", ["to_qualified", "from_qualified"]),
    "grams": ("gram", ["gram", "first_qualified"]),
    "versions": ("file_path", ["file_path"]),
}

MARKER = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("source_batch", T.LongType()),
        T.StructField("published", T.DoubleType()),
        T.StructField("feed", T.StringType()),
        T.StructField("manifest", T.StringType()),
    ]
)
MANIFEST = "table string, bucket int, buckets int, path string, schema string"
MANIFESTS_KEPT = 16
_MANIFESTS: dict[str, list[dict]] = {}


class ConcurrentPublish(RuntimeError):
    """Another writer has published the version after the one this run started from."""


@dataclass(frozen=True)
class Change:
    """What an update does to a table: ``apply`` turns its old rows into the new ones, and only rows with one of ``keys(key)`` differ."""

    keys: DataFrame
    apply: Callable[[DataFrame], DataFrame]


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    at, system = _file_system(spark, path)
    return system.exists(at)


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """One row per published version; empty before the first one."""
    if not _exists(spark, f"{root}/versions"):
        return spark.createDataFrame([], MARKER)
    return spark.read.schema(MARKER).json(f"{root}/versions")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, oldest first; a listing of one directory."""
    at, system = _file_system(spark, f"{root}/versions")
    if not system.exists(at):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(at)]
    return sorted(int(name[1:-5]) for name in names if name.startswith("v") and name.endswith(".json"))


def current_version(spark: SparkSession, root: str) -> int | None:
    return max(versions(spark, root), default=None)


def _marker(root: str, version: int) -> str:
    return f"{root}/versions/v{version:08d}.json"


def _claim(spark: SparkSession, root: str, version: int, **content) -> bool:
    """Create the marker of a version; false when it is there already."""
    at, system = _file_system(spark, _marker(root, version))
    try:
        stream = system.create(at, False)
    except Exception:
        if system.exists(at):
            return False
        raise
    stream.write(bytearray(json.dumps({"version": version, "published": time.time(), **content}).encode()))
    stream.close()
    return True


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(root: str, name: str, rows: DataFrame, buckets: int) -> str:
    """Write rows by bucket, large buckets as several files; the directory below ``root``."""
    key, order = KEYS[name]
    place = f"data/{name}/{uuid.uuid4().hex}"
    dealt = rows.withColumn("bucket", bucket_of(F.col(key), buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{root}/{place}")
    return place


def _buckets_in(spark: SparkSession, root: str, place: str) -> list[int]:
    at, system = _file_system(spark, f"{root}/{place}")
    names = [entry.getPath().getName() for entry in system.listStatus(at)]
    return sorted(int(name[7:]) for name in names if name.startswith("bucket="))


def _manifest_place(spark: SparkSession, root: str, version: int) -> str:
    at, system = _file_system(spark, _marker(root, version))
    stream = system.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["manifest"]
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str, version: int) -> list[dict]:
    """Rows of a version's manifest: at most one for every table and bucket. A manifest never changes, so the last few are kept."""
    place = f"{root}/{_manifest_place(spark, root, version)}"
    if place not in _MANIFESTS:
        while len(_MANIFESTS) >= MANIFESTS_KEPT:
            _MANIFESTS.pop(next(iter(_MANIFESTS)), None)
        _MANIFESTS[place] = [row.asDict() for row in spark.read.schema(MANIFEST).parquet(place).collect()]
    return _MANIFESTS[place]


def _tables(rows: list[dict]) -> dict[str, dict]:
    """``buckets``, ``schema`` and the ``paths`` of its buckets for every table of a manifest."""
    out = {r["table"]: {"buckets": r["buckets"], "schema": r["schema"], "paths": {}} for r in rows if r["bucket"] < 0}
    for r in rows:
        if r["bucket"] >= 0:
            out[r["table"]]["paths"][r["bucket"]] = r["path"]
    return out


def _read(spark: SparkSession, root: str, table: dict, only: set[int] | None = None) -> DataFrame:
    """A table, or at least the rows of some of its buckets."""
    schema = T.StructType.fromJson(json.loads(table["schema"]))
    paths = [f"{root}/{path}" for bucket, path in sorted(table["paths"].items()) if only is None or bucket in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _finish(
    spark: SparkSession, root: str, tables: Mapping[str, dict], base: int | None, source_batch: int | None, feed: str | None
) -> int:
    """Write the manifest and claim the version: the one after ``base``, or the next free one without a base."""
    rows = []
    for name, table in tables.items():
        rows.append((name, -1, table["buckets"], None, table["schema"]))
        rows += [(name, bucket, table["buckets"], path, None) for bucket, path in table["paths"].items()]
    place = f"manifest/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{root}/{place}")
    version = (current_version(spark, root) or 0) + 1 if base is None else base + 1
    while not _claim(spark, root, version, source_batch=source_batch, feed=feed, manifest=place):
        if base is not None:
            raise ConcurrentPublish(f"version {version} below {root} was published by another run")
        version += 1
    return version


def _side_by_side(write: Callable[[str], dict], names: Iterable[str]) -> dict[str, dict]:
    """``write(name)`` for all tables at once: their jobs are independent, and small ones leave most of a cluster idle."""
    names = list(names)
    with ThreadPoolExecutor(len(names)) as pool:
        return dict(zip(names, pool.map(write, names)))


def publish(
    root: str, tables: Mapping[str, DataFrame], source_batch: int | None = None, feed: str | None = None, buckets: int = BUCKETS
) -> int:
    """Write all ``tables`` as the next version below ``root``; they become visible together."""
    spark = next(iter(tables.values())).sparkSession

    def write(name: str) -> dict:
        place = _write(root, name, tables[name], buckets)
        paths = {k: f"{place}/bucket={k}" for k in _buckets_in(spark, root, place)}
        return {"buckets": buckets, "schema": tables[name].schema.json(), "paths": paths}

    return _finish(spark, root, _side_by_side(write, tables), None, source_batch, feed)


def publish_changes(
    spark: SparkSession, root: str, base: int, changes: Mapping[str, Change], source_batch: int | None = None, feed: str | None = None
) -> int:
    """Publish the version after ``base`` in which only the buckets of changed keys are written anew.

    Fails with ``ConcurrentPublish`` when another run has published that version. At most one number per bucket reaches the driver.
    """
    tables = _tables(manifest(spark, root, base))

    def write(name: str) -> dict:
        table, change = tables[name], changes[name]
        touched = change.keys.select(bucket_of(F.col("key"), table["buckets"]).alias("bucket")).distinct()
        touched = {row[0] for row in touched.collect()}
        if not touched:
            return table
        rows = change.apply(_read(spark, root, table, touched))
        place = _write(root, name, rows, table["buckets"])
        new = {k: f"{place}/bucket={k}" for k in _buckets_in(spark, root, place)}
        return {**table, "paths": {k: path for k, path in table["paths"].items() if k not in touched} | new}

    return _finish(spark, root, {**tables, **_side_by_side(write, changes)}, base, source_batch, feed)


def table_names(spark: SparkSession, root: str, version: int | None) -> list[str]:
    """The tables of a version."""
    if version is None:
        raise FileNotFoundError(f"nothing published below {root}")
    return list(_tables(manifest(spark, root, version)))


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """A table of a version, the newest one unless given; with ``keys(key)`` only the buckets that may hold one of them."""
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing published below {root}")
    table = _tables(manifest(spark, root, version))[name]
    only = None
    if keys is not None:
        only = {row[0] for row in keys.select(bucket_of(F.col("key"), table["buckets"])).distinct().collect()}
    return _read(spark, root, table, only)


def expire(spark: SparkSession, root: str, keep: int) -> int:
    """Delete all but the newest ``keep`` versions and the directories that no kept version uses; the number of versions deleted.

    A reader of a deleted version fails, and a write that is not published yet is taken for unused: run it when neither is under way.
    """
    if keep < 1:
        raise ValueError("at least one version must be kept")
    known = versions(spark, root)
    old, kept = known[:-keep], known[-keep:]
    used = {r["path"] for v in kept for r in manifest(spark, root, v) if r["path"]}
    for v in old:
        for path in (f"{root}/{_manifest_place(spark, root, v)}", _marker(root, v)):
            at, system = _file_system(spark, path)
            system.delete(at, True)
    at, system = _file_system(spark, f"{root}/data")
    for table in system.listStatus(at) if system.exists(at) else []:
        for write in system.listStatus(table.getPath()):
            place = f"data/{table.getPath().getName()}/{write.getPath().getName()}"
            for bucket in system.listStatus(write.getPath()):
                if f"{place}/{bucket.getPath().getName()}" not in used:
                    system.delete(bucket.getPath(), True)
            if not any(path.startswith(f"{place}/") for path in used):
                system.delete(write.getPath(), True)
    return len(old)
