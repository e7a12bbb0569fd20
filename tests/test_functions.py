"""Column functions against plain Python."""

import fnmatch
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from skein import cut, fits_broadcast, shared_folder
from skein.functions import paths, text
from skein.functions.answers import ranked, with_limits
from skein.functions.patterns import basic_to_java, matches


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i")
    return [row[0] for row in df.select(expression(F.col("v"))).collect()]


AWKWARD_PATHS = [".py", "x/..py", "a..py", "a.py", "./src/a.py", "/a/b.py", "a.b/c", "x/.a.py", "a.", "noext", "d.d/e.tar.gz"]


def test_module_path_and_base_name(spark):
    assert column(spark, AWKWARD_PATHS, paths.module_path) == [os.path.splitext(p)[0].replace("/", ".") for p in AWKWARD_PATHS]
    assert column(spark, AWKWARD_PATHS, paths.base_name) == [os.path.basename(p) for p in AWKWARD_PATHS]
    assert column(spark, AWKWARD_PATHS, paths.extension) == [os.path.splitext(p)[1][1:] for p in AWKWARD_PATHS]
    assert column(spark, ["src/a/b.py", "lib/c.py"], lambda c: paths.module_path(c, "src/")) == ["a.b", "lib.c"]


def test_globs(spark):
    names = ["a.py", "ab.py", "a.pyc", "x-1.js", "x]1.js", "[a].py"]
    for glob in ["*.py", "?.py", "x[]-]1.js", "[!a]*", "*", "[[]a].py"]:
        want = [fnmatch.fnmatchcase(n, glob) for n in names]
        assert column(spark, names, lambda c, g=glob: paths.base_name_matches(c, [g])) == want, glob
    found = column(spark, ["a/src1/b.py", "src1.py", "x/y/z"], lambda c: paths.directory_matches(c, ["src?", "y"]))
    assert found == [True, False, True]


def test_strip_and_lines_equal_python(spark):
    rng = random.Random(7)
    alphabet = " \t\n\r\x0b\x0c\x1c\x1e\x85\xa0\u1680\u2003\u2028\u3000abé\U0001f600"
    values = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(800)] + ["", "\n", "a\n\n"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.right_strip) == [v.rstrip() for v in values]
    assert column(spark, values, lambda c: text.line_count(c, text.UNICODE_NEWLINE)) == [len(v.splitlines()) for v in values]
    by_newline = [v.split("\n")[:-1] if v.split("\n")[-1] == "" else v.split("\n") for v in values]
    assert column(spark, values, text.split_lines) == by_newline
    assert column(spark, values, text.line_count) == [len(lines) for lines in by_newline]


def test_decode_replaces_like_python(spark):
    rng = random.Random(3)
    values = [bytes(rng.choices([0x41, 0x80, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0xFF], k=6)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v binary").orderBy("i")
    got = [row[0] for row in df.select(text.decode_utf8(F.col("v"))).collect()]
    assert got == [v.decode("utf-8", "replace") for v in values]


@pytest.mark.parametrize(
    "pattern, hits, misses",
    [
        ("f(x)", ["f(x)"], ["fx"]),
        (r"\(ab\)*c", ["c", "ababc"], ["x"]),
        (r"a\{2\}b", ["aab"], ["ab"]),
        ("a{2}", ["a{2}"], ["aa"]),
        ("*a", ["*a"], ["a"]),
        (r"a\|b", ["b"], ["c"]),
        ("a+b", ["a+b"], ["aab"]),
        (r"a\+b", ["aab"], ["b"]),
        ("^a$", ["a"], ["ba"]),
        ("a^b$c", ["a^b$c"], ["abc"]),
        ("[[:digit:]x]z", ["4z", "xz"], ["yz"]),
        ("[]a]", ["]", "a"], ["b"]),
        ("[^]a]", ["b"], ["]a"]),
        (r"\<ab\>", ["x ab y"], ["xab"]),
        (r"a\.b", ["a.b"], ["axb"]),
        (r"\(a\)\1", ["aa"], ["ab"]),
    ],
)
def test_basic_dialect(spark, pattern, hits, misses):
    got = column(spark, hits + misses, lambda c: matches(c, pattern, "basic"))
    assert got == [True] * len(hits) + [False] * len(misses), basic_to_java(pattern)


def test_literal_dialect_and_unknown_dialect(spark):
    assert column(spark, ["a.c", "abc"], lambda c: matches(c, "a.c", "literal")) == [True, False]
    with pytest.raises(ValueError):
        matches(F.lit("a"), "a", "perl")


def test_ranked_with_a_hot_key(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", i) for i in range(3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    for limit in (2, 1500):
        got = sorted((r.k, r.v, r["rank"]) for r in ranked(df, ["k"], ["v"], limit).collect())
        want = [("cold", i, i + 1) for i in range(min(3, limit))] + [("hot", i, i + 1) for i in range(limit)]
        assert got == want
    plan = ranked(df, ["k"], ["v"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle, once after
    assert ranked(df, ["k"], ["v"], None).count() == 5003
    with pytest.raises(ValueError):
        ranked(df, ["k"], ["v"], -1)


def test_limits_of_requests(spark):
    df = spark.createDataFrame([("a", 3), ("b", None)], "request_id string, lim int")
    requests, top = with_limits(df, 10)
    assert top == 10 and {r.request_id: r.lim for r in requests.collect()} == {"a": 3, "b": 10}
    with pytest.raises(ValueError):
        with_limits(df, None)
    with pytest.raises(ValueError):
        with_limits(spark.createDataFrame([("a", -1)], "request_id string, lim int"), 5)


def test_glob_regex_is_anchored():
    assert re.search(paths.glob_regex("*.py").replace(r"\z", r"\Z"), "x.pyc") is None


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = shared_folder(spark)
    assert folder == configured.rstrip("/") if configured else folder == spark.sparkContext.getCheckpointDir()
    table = cut(spark.range(5).withColumn("t", F.lit("x")), "check")
    assert table.count() == 5 and folder in table.inputFiles()[0]


def test_broadcast_check_counts_rows_and_bytes(spark):
    df = spark.range(100).withColumn("t", F.lit("x" * 50))
    assert fits_broadcast(df) and not fits_broadcast(df, rows=99) and not fits_broadcast(df, size=1000)
    assert fits_broadcast(df.filter("id < 0"))
