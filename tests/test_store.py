"""Versions in buckets: what an update writes, who may publish, what expires."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.functions.membership import LEAST_BITS, bits_for, may_be_in, membership
from skein.operators import maintain
from skein.plans.indexing import TABLES, index_corpus, load_index, update_index
from skein.sources import store
from skein.sources.store import ConcurrentPublish, current_version, expire, publish, read_table, versions

N = 200


def tree(changed=()) -> dict[str, bytes]:
    """A package of many small modules, each calling the one before it; changed ones have one more function."""
    out = {}
    for i in range(N):
        body = f"import p.m{i - 1}\n\ndef f{i}():\n    return p.m{i - 1}.f{i - 1}()\n"
        out[f"p/m{i}.py"] = (body + (f"\ndef g{i}():\n    return len(p.m{i}.f{i}())\n" if i in changed else "")).encode()
    return out


def scan(spark, files):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "file_path string, content binary")


def content(df):
    return sorted(map(repr, df.drop("last_indexed").collect()))


def written(root) -> set[str]:
    return {str(p.relative_to(root)) for p in Path(root).glob("data/*/*/bucket=*") if list(p.glob("*.parquet"))}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store") / "index")
    index_corpus(scan(spark, tree())).publish(root, buckets=64, grams=True)
    return root


def test_an_update_writes_touched_buckets_only(spark, root):
    before = written(root)
    first = load_index(spark, root)
    update_index(first, scan(spark, tree({7, 90}))).publish(root)
    assert versions(spark, root) == [1, 2]
    fresh: dict[str, int] = {}
    for path in written(root) - before:
        fresh[path.split("/")[1]] = fresh.get(path.split("/")[1], 0) + 1
    # two files of 200, in 64 buckets; each has a handful of names and edges
    assert fresh["files"] == fresh["symbols"] == fresh["raw_edges"] == 2
    assert fresh["names"] <= 8 and fresh["edges"] <= 14
    got, want = load_index(spark, root), index_corpus(scan(spark, tree({7, 90})))
    for name in TABLES:
        assert content(getattr(got, name)) == content(getattr(want, name)), name
    assert content(got.grams) == content(load_grams(spark, want))
    # the old version still answers
    assert content(read_table(spark, root, "symbols", 1)) == content(index_corpus(scan(spark, tree())).symbols)


def load_grams(spark, index):
    from skein.operators.name_index import name_grams

    return name_grams(index.symbols)


def test_two_writers_cannot_share_a_version(spark, root):
    base = load_index(spark, root)
    one, two = (update_index(base, scan(spark, {"p/m3.py": text})) for text in (b"x = 1\n", b"def two():\n    pass\n"))
    number = one.publish(root)
    with pytest.raises(ConcurrentPublish):
        two.publish(root)
    assert current_version(spark, root) == number
    assert read_table(spark, root, "symbols").filter("file_path = 'p/m3.py'").count() == 1
    # without a base there is nothing to lose: the next number is taken
    assert publish(root, {"files": base.files}) == number + 1


def test_keys_read_their_buckets(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"), "id")
    publish(f"{tmp_path}/t", {"files": rows}, buckets=32)
    some = spark.createDataFrame([("f3",), ("f77",), ("gone",)], "key string")
    part = read_table(spark, f"{tmp_path}/t", "files", keys=some)
    assert {"f3", "f77"} <= {r.file_path for r in part.collect()} and part.count() < 100
    assert read_table(spark, f"{tmp_path}/t", "files", keys=some.filter("key = ''")).count() == 0
    nothing = rows.filter("id < 0")
    publish(f"{tmp_path}/t", {"files": nothing})
    assert read_table(spark, f"{tmp_path}/t", "files").dtypes == rows.dtypes


def test_a_hot_key_is_one_bucket_of_several_files(spark, tmp_path, monkeypatch):
    rows = spark.range(20_000).select(F.lit("hot").alias("to_qualified"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("from_qualified"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        publish(f"{tmp_path}/t", {"edges": rows}, buckets=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list(Path(f"{tmp_path}/t/data/edges").glob("*/bucket=*/*.parquet"))
    assert len({f.parent for f in files}) == 1 and len(files) > 1
    assert read_table(spark, f"{tmp_path}/t", "edges").count() == 20_000


def test_old_versions_expire(spark, tmp_path):
    root = f"{tmp_path}/index"
    index_corpus(scan(spark, tree())).publish(root, buckets=8)
    for changed in ({1}, {1, 2}):
        update_index(load_index(spark, root), scan(spark, tree(changed))).publish(root)
    newest = {name: content(read_table(spark, root, name)) for name in TABLES}
    used = {r["path"] for r in store.manifest(spark, root, 3) if r["path"]}
    with pytest.raises(ValueError):
        expire(spark, root, 0)
    assert expire(spark, root, 1) == 2 and versions(spark, root) == [3]
    assert {name: content(read_table(spark, root, name)) for name in TABLES} == newest
    assert written(root) == used


def test_conflicts_with_unchanged_files(spark, tmp_path):
    root = f"{tmp_path}/index"
    files = {"a.py": b"class b:\n    pass\n", "z.py": b"import a\n"}
    index_corpus(scan(spark, files)).publish(root)
    clash = {"a/b.py": b"x = 1\n"}
    with pytest.raises(ValueError, match="a.b"):
        update_index(load_index(spark, root), scan(spark, clash))
    first = update_index(load_index(spark, root), scan(spark, clash), on_conflict="first")
    assert {(r.qualified_name, r.file_path) for r in first.names.collect()} >= {("a.b", "a.py")}
    assert first.symbols.filter("file_path = 'a/b.py'").count() == 0
    # the smaller path wins, also over a file that did not change
    other = f"{tmp_path}/other"
    index_corpus(scan(spark, {"a/b.py": b"x = 1\n"})).publish(other)
    update_index(load_index(spark, other), scan(spark, {"a.py": b"class b:\n    pass\n"}), on_conflict="first").publish(other)
    assert [tuple(r) for r in read_table(spark, other, "names").filter("qualified_name = 'a.b'").collect()] == [("a.b", "a.py")]
    assert read_table(spark, other, "symbols").filter("file_path = 'a/b.py'").count() == 0


@pytest.mark.parametrize("bits", [1 << 15, LEAST_BITS])
def test_membership_loses_nothing(spark, bits):
    values = spark.range(2000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("v"), F.lit("x").alias("part"))
    asked = spark.range(4000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("v"), F.lit("x").alias("bitmap"))
    got = {r.v for r in may_be_in(asked, "v", membership(values, "v", bits), bits).collect()}
    assert {f"n{i}" for i in range(2000)} <= got and len(got) < 2000 + (400 if bits == 1 << 15 else 20)
    assert may_be_in(asked, "v", membership(values.limit(0), "v", bits), bits).count() == 0
    assert bits_for(0) == LEAST_BITS and bits_for(10**12) == 1 << 27


def test_resolution_with_and_without_false_alarms(spark):
    files = scan(spark, {**tree({5}), "p/x.py": b"def h():\n    print(len(str(1)))\n    p.m1.f1()\n"})
    index = index_corpus(files)
    for bits in (1 << 15, 1 << 20):
        again = maintain.resolve_edges(index.raw_edges, index.symbols, bits=bits)
        assert content(again) == content(index.edges)
    members = membership(index.symbols, "qualified_name", 1 << 20)
    left = {r.to_qualified for r in may_be_in(index.raw_edges, "to_qualified", members, 1 << 20).collect()}
    assert "len" not in left and "print" not in left
