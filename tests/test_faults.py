"""Input that must not lose data, give wrong answers or end a job."""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein import clear_scratch, cut, shared_folder
from skein.functions import paths
from skein.functions.patterns import basic_to_java
from skein.operators import semantic
from skein.operators.context import line_context
from skein.operators.extract import PYTHON, Extractor, extract, python_batches, symbols_of
from skein.plans.indexing import index_corpus, index_tree
from skein.sources import files
from skein.sources.store import pointers, read_table
from skein.streaming.feed import apply_versions, run_feed


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i")
    return [row[0] for row in df.select(expression(F.col("v"))).collect()]


def test_a_feed_with_a_new_checkpoint_loses_nothing(spark, tmp_path):
    schema = "file_path string, content string, n long"
    body = apply_versions(f"{tmp_path}/out", ["n"])
    for run, source in enumerate(["a", "b"]):
        for i in range(2):
            row = spark.createDataFrame([(f"{source}{i}", f"text {i}", i)], schema)
            row.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{source}")
        changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{source}")
        for _ in range(2):  # the second time, the checkpoint has it all
            run_feed(changes, body, f"{tmp_path}/checkpoint{run}")
    got = {r.file_path for r in read_table(spark, f"{tmp_path}/out", "versions").collect()}
    assert got == {"a0", "a1", "b0", "b1"}
    done = [tuple(r) for r in pointers(spark, f"{tmp_path}/out").select("feed", "source_batch").collect()]
    assert len(done) == len(set(done)) == 4 and len({feed for feed, _ in done}) == 2


def test_a_replayed_batch_is_skipped(spark, tmp_path):
    batch = spark.createDataFrame([("a", "x", 1)], "file_path string, content string, n long")
    body = apply_versions(f"{tmp_path}/out", ["n"], feed="named")
    body(batch, 5)
    body(batch, 5)
    body(batch, 3)  # not a batch of before: another id of the feed
    assert pointers(spark, f"{tmp_path}/out").count() == 2


def test_queries_with_one_id_all_get_answers(spark, monkeypatch):
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 10)
    monkeypatch.setattr(semantic, "VECTOR_BLOCK", 200)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([("same", rows[i][1]) for i in range(5)], "request_id string, embedding array<double>")
    got = semantic.search_semantic(vectors, asked, 2).collect()
    assert len(got) == 10 and {r.vec_id for r in got if r["rank"] == 1} == set(range(5))


def test_names_of_archives_are_read_as_they_are(spark, tmp_path):
    (tmp_path / "src").mkdir()
    packed = gzip.compress(b"x = 1\n")
    (tmp_path / "src" / "real.gz").write_bytes(packed)
    (tmp_path / "src" / "fake.gz").write_bytes(b"not an archive")
    got = {r.file_path: bytes(r.content) for r in files.scan_tree(spark, f"{tmp_path}/src").collect()}
    assert got == {"src/real.gz": packed, "src/fake.gz": b"not an archive"}


@pytest.mark.parametrize("error, fails", [(OSError("slow down"), True), (FileNotFoundError("gone"), False), (PermissionError("no"), False)])
def test_only_missing_files_are_skipped(monkeypatch, error, fails):
    class Store:
        def open_input_stream(self, path, compression=None):
            raise error

    monkeypatch.setattr(files, "_opened", lambda path: (Store(), path, "", ""))
    read = files._read_files(iter([pa.record_batch([pa.array(["s3://b/x"])], ["path"])]))
    if fails:
        with pytest.raises(OSError):
            list(read)
    else:
        assert sum(b.num_rows for b in read) == 0


ODD_NAMES = ["a#b.py", "c.py", "d%41.py", "e?f.py", "blank in name.py", "\u00fc\u6f22.py", "sub dir#1/g%20h.py", "plus+.py", "semi;.py"]


def test_names_below_a_uri_are_taken_as_they_are(spark, tmp_path):
    for i, name in enumerate(ODD_NAMES):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(f"x = {i}\n".encode())
    want = {f"src/{name}": f"x = {i}\n".encode() for i, name in enumerate(ODD_NAMES)}
    listing = spark.createDataFrame([(name,) for name in ODD_NAMES], "file_path string")
    for root in (f"{tmp_path}/src", f"file://{tmp_path}/src", f"file://{tmp_path}/src/"):
        assert {r.file_path: bytes(r.content) for r in files.scan_tree(spark, root).collect()} == want
        assert {r.file_path: bytes(r.content) for r in files.scan_listed(listing, root).collect()} == want


def test_excluded_directories_are_not_listed(spark, tmp_path):
    for name in ("a.py", "node_modules/deep/b.py", ".git/c.py", "ok/d.py", "ok/builder.py", "ok/e.txt"):
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(b"x = 1\n")
    index = index_tree(spark, f"{tmp_path}/src")
    assert {r.file_path for r in index.files.collect()} == {"src/a.py", "src/ok/d.py"}
    (tmp_path / "src" / "node_modules").chmod(0)  # entering it would fail
    try:
        assert index_tree(spark, f"{tmp_path}/src").files.count() == 2
        walked = files.walk_tree(spark, f"{tmp_path}/src", enter=lambda path: ~F.contains(path, F.lit("node_modules")))
        assert walked.filter(F.contains("path", F.lit("node_modules"))).count() == 0
    finally:
        (tmp_path / "src" / "node_modules").chmod(0o755)


def test_excluded_and_unlisted_files_are_not_read(spark, tmp_path):
    root = tmp_path / "src"
    for name in ("a.py", "b.py", "build/c.py", "note.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    assert sorted(r.file_path for r in files.scan_tree(spark, str(root), exclude=["build"], globs=["*.py"]).collect()) == ["src/a.py", "src/b.py"]
    listing = spark.createDataFrame([("src/b.py",), ("src/gone.py",)], "file_path string")
    assert [r.file_path for r in files.scan_tree(spark, str(root), listing=listing).collect()] == ["src/b.py"]


ODD_SOURCES = {
    "src/surrogate.py": b'def f():\n    """\\ud800 half"""\n',
    "src/bytes.py": b'x = "\xff"\nclass A:\n    pass\n',
    "src/deep.py": b"(" * 5000,
    "src/good.py": b"def g():\n    pass\n",
}


def test_odd_sources_do_not_end_the_job(spark):
    scan = spark.createDataFrame(list(ODD_SOURCES.items()), "file_path string, content binary")
    index = index_corpus(scan)
    names = {(r.name, r.summary) for r in index.symbols.filter("kind <> 'file'").collect()}
    assert names == {("f", "\ufffd half"), ("A", ""), ("g", "")}
    hashes = {r.file_path: r.content_hash for r in index.files.collect()}
    want = files.with_hash(scan).collect()
    assert hashes == {r.file_path: r.content_hash for r in want}


def test_memory_errors_of_a_task_are_not_rejects(monkeypatch):
    from skein.operators import extract as module

    def full(*_):
        raise MemoryError

    monkeypatch.setattr(module, "scan_python", full)
    with pytest.raises(MemoryError):
        module._parses("a.py", "a", "x")


def test_a_second_extractor(spark):
    def text_body(batches):
        return python_batches(
            pa.record_batch([*b.columns[:2], pa.array(["class Note: pass"] * b.num_rows), *b.columns[3:]], b.schema.names) for b in batches
        )

    notes = Extractor("notes", lambda path: F.endswith(path, F.lit(".md")), text_body)
    df = spark.createDataFrame([("src/a.py", "def f(): pass"), ("src/n.md", "anything"), ("src/x.js", "no")], "file_path string, text string")
    got = symbols_of(extract(df, [PYTHON, notes], strip_prefix="src/")).select("file_path", "qualified_name").collect()
    assert {tuple(r) for r in got} == {("src/a.py", "a.f"), ("src/a.py", "a"), ("src/n.md", "n.Note"), ("src/n.md", "n")}


def test_bounds_and_classes_of_patterns(spark):
    assert basic_to_java(r"ba\{,2\}c").endswith("ba{0,2}c")
    assert column(spark, ["bc", "baac", "baaac"], lambda c: F.rlike(c, F.lit("^" + basic_to_java(r"ba\{,2\}c")))) == [True, True, False]
    names = ["ab.py", "1b.py", "*.py", "a.py", "]x"]
    assert column(spark, names, lambda c: paths.base_name_matches(c, ["[[:alpha:]]*.py"])) == [True, False, False, True, False]
    assert column(spark, names, lambda c: paths.base_name_matches(c, [r"\*.py"])) == [False, False, True, False, False]
    assert column(spark, names, lambda c: paths.base_name_matches(c, ["[![:digit:]]b.py", "[]]x"])) == [True, False, False, False, True]


def test_a_huge_radius_on_an_unknown_file(spark):
    text = spark.createDataFrame([("a", "one\ntwo\n")], "file_path string, text string")
    asked = spark.createDataFrame([(1, "a", 1, 10**9), (2, "gone", 1, 10**9)], "request_id int, file_path string, line long, radius long")
    got = {r.request_id: r.context for r in line_context(text, asked).collect()}
    assert got[1] == "1: one\n2: two" and got[2].startswith("Error reading file")


def test_scratch_tables_can_be_cleared(spark):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/skein")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    cut(spark.range(3), "x")
    assert store.exists(folder)
    clear_scratch(spark)
    assert not store.exists(folder)
