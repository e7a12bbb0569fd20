"""Query operators against brute force on small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.functions.skew import hot_keys, salted_join
from skein.operators import grep as grep_module
from skein.operators import multi_search
from skein.operators.context import file_head, line_context
from skein.operators.grep import grep, grep_requests
from skein.operators.semantic import search_semantic
from skein.operators import shortest_path
from skein.operators.shortest_path import path_between
from skein.operators.summary import file_summary, touches_model
from skein.operators.symbol_search import display, search_substring, search_symbol
from skein.operators.usages import find_usages
from skein.schemas import SYMBOLS, conform

FILES = {
    "a/one.py": "def get_user():\n    return get(1)\n\nx = 'µ\U0001f600ser'\n",
    "a/two.js": "getUser();\r\nvar user = 1;",
    "b/three.md": "no code here, get it\n",
    "b/bin.py": "get\0get\n",
    "b/empty.py": "",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "file_path string, text string").cache()


@pytest.fixture(scope="module")
def symbols(spark):
    names = ["get", "get_user", "getXuser", "GetUser", "User", "user", "a\\b", "100%", "Übung"]
    rows = [(n, f"m{k}.{n}", kind, f"f{k}.py", k, "s") for k, kind in enumerate(["function", "class"]) for n in names]
    df = spark.createDataFrame(rows, "name string, qualified_name string, kind string, file_path string, line_start int, summary string")
    return conform(df, SYMBOLS).cache()


def lines(text):
    parts = text.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def brute_grep(pattern):
    return sorted(
        (path, number, line.strip())
        for path, text in FILES.items()
        if "\0" not in text
        for number, line in enumerate(lines(text), 1)
        if pattern in line
    )


def found(df):
    return sorted((r.file_path, r.line_start, r.match_text) for r in df.collect())


def test_grep_literal_limit_and_scope(files):
    assert found(grep(files, "get", limit=None)) == brute_grep("get")
    assert found(grep(files, "get", limit=2)) == brute_grep("get")[:2]
    assert {r.file_path for r in grep(files, "get", ["*.js", "*.md"], ["b"], limit=None).collect()} == {"a/two.js"}
    assert grep(files, "get", limit=0).count() == 0
    with pytest.raises(Exception):
        grep(files, "(", limit=None).collect()
    with pytest.raises(ValueError):
        grep(files, "get", limit=-1)


@pytest.mark.parametrize("per_page, held", [(20_000, 500_000), (2, 1)])
def test_many_patterns(spark, files, monkeypatch, per_page, held):
    monkeypatch.setattr(multi_search, "PAGE_ROWS", per_page)
    monkeypatch.setattr(multi_search, "HELD", held)
    monkeypatch.setattr(grep_module, "EXPRESSIONS_PER_PASS", 1 if held == 1 else 256)
    patterns = ["get", "user", "e", "\U0001f600", "µ\U0001f600s", "nothing", "", "return get"]
    asked = spark.createDataFrame([(f"{i}", p) for i, p in enumerate(patterns)] + [("again", "get")], "request_id string, pattern string")
    got = grep_requests(files, asked, limit=None, dialect="literal").collect()
    for i, pattern in enumerate(patterns):
        assert sorted((r.file_path, r.line_start, r.match_text) for r in got if r.request_id == str(i)) == brute_grep(pattern), pattern
    assert len([r for r in got if r.request_id == "again"]) == len(brute_grep("get"))
    regexes = spark.createDataFrame([("r1", "^get"), ("r2", "use[r]"), ("r3", "g.t"), ("r4", "code")], "request_id string, pattern string")
    counts = {r.request_id: r["count"] for r in grep_requests(files, regexes, limit=None, dialect="basic").groupBy("request_id").count().collect()}
    assert counts == {"r1": 1, "r2": 2, "r3": 4, "r4": 1}


def brute_like(pattern, name):
    import re

    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower())
    return re.search(body, name.lower(), re.S) is not None


def test_substring_wildcards(spark, symbols):
    asked = ["get_user", "%user", "_", "", "%", "\\", "0%", "GETX", "übu", "________", "a_b"]
    requests = spark.createDataFrame([(p, p) for p in asked], "request_id string, name string")
    names = symbols.select("name", "qualified_name").collect()
    for wildcards in (True, False):
        got = search_substring(symbols, requests, limit=None, wildcards=wildcards).collect()
        for p in asked:
            want = {r.qualified_name for r in names if (brute_like(p, r.name) if wildcards else p.lower() in r.name.lower())}
            assert {r.qualified_name for r in got if r.request_id == p} == want, (p, wildcards)
    first = search_substring(symbols, requests, limit=3).filter("request_id = '_'").orderBy("qualified_name").collect()
    assert [r.qualified_name for r in first] == sorted(r.qualified_name for r in names)[:3]


def test_search_tiers(spark, symbols, files):
    rows = [("exact", "get", None, 5), ("kind", "get", "class", 5), ("loose", "etus", "", 5), ("text", "return", None, 1), ("none", "zzz", None, 5), ("zero", "get", None, 0)]
    requests = spark.createDataFrame(rows, "request_id string, name string, kind string, lim int")
    hits = search_symbol(symbols, requests, files)
    got = {}
    for r in hits.collect():
        got.setdefault(r.request_id, []).append((r.source, r.qualified_name or r.file_path))
    assert sorted(got["exact"]) == [("graph", "m0.get"), ("graph", "m1.get")]
    assert got["kind"] == [("graph", "m1.get")]
    assert sorted(got["loose"]) == [("graph", "m0.GetUser"), ("graph", "m1.GetUser")]
    assert got["text"] == [("grep", "a/one.py")]
    assert "none" not in got and "zero" not in got
    shown = {r.request_id: r.line for r in display(hits).filter("request_id in ('kind', 'text')").collect()}
    assert shown == {"kind": "[graph] m1.get - class @ 1", "text": "[grep] a/one.py - grep @ 2"}


def test_usages(spark, symbols, files):
    edges = spark.createDataFrame(
        [("m0.get", "m0.User", "calls"), ("m1.get", "m0.User", "calls"), ("m0.get", "m0.User", "imports")],
        "from_qualified string, to_qualified string, relation string",
    )
    requests = spark.createDataFrame([("used", "m0.User"), ("unused", "m1.user"), ("unknown", "x.y.zzz")], "request_id string, qualified_name string")
    got = find_usages(symbols, edges, requests, files, limit=2).collect()
    assert sorted((r.request_id, r.from_qualified or r.file_path, r.relation, r.source) for r in got) == [
        ("unused", "a/one.py", None, "grep"),
        ("unused", "a/two.js", None, "grep"),
        ("used", "m0.get", "calls", "graph"),
        ("used", "m0.get", "imports", "graph"),
    ]
    assert find_usages(symbols, edges, requests, limit=None).count() == 3


def brute_context(text, line, radius):
    rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    rows = rows[:-1] if rows[-1] == "" else rows
    return "\n".join(f"{i + 1}: {rows[i].rstrip()}" for i in range(max(0, line - radius - 1), min(len(rows), line + radius)))


def test_line_context(spark):
    text = "".join(f"line {i} \r\n" if i % 3 else f"line {i}\r" for i in range(1, 301)) + "last"
    files = spark.createDataFrame([("f", text), ("empty", "")], "file_path string, text string")
    asked = [("f", 1, 0), ("f", 64, 2), ("f", 301, 1), ("f", 302, 1), ("f", 500, 3), ("f", 5, 2**31 - 1), ("f", -3, 5), ("f", -30, 5), ("f", 150, 100), ("empty", 1, 2)]
    requests = spark.createDataFrame([(str(i), *a) for i, a in enumerate(asked)] + [("lost", "g", 1, 1)], "request_id string, file_path string, line int, radius int")
    got = {r.request_id: r.context for r in line_context(files, requests).collect()}
    for i, (path, line, radius) in enumerate(asked):
        assert got[str(i)] == brute_context(text if path == "f" else "", line, radius), asked[i]
    assert got["lost"] == "Error reading file: [Errno 2] No such file or directory: 'g'"


def test_context_of_long_files(spark):
    rng = random.Random(9)
    texts = {f"t{k}": "".join(rng.choice(["", "a b ", "x" * 300]) + rng.choice(["\n", "\r\n", "\r", "\n\r", "\x0b"]) for _ in range(rng.randint(120, 400))) for k in range(4)}
    texts |= {"long": "y" * 2_000_000 + "\n" + "z", "blank": "\n" * 200, "one": "\r"}
    asked = [(f"{p}.{line}.{r}", p, line, r) for p in texts for line, r in [(1, 0), (63, 1), (64, 0), (65, 64), (128, 3), (190, 70), (64, 2**31 - 1)]]
    files = spark.createDataFrame(list(texts.items()), "file_path string, text string")
    requests = spark.createDataFrame(asked, "request_id string, file_path string, line int, radius int")
    got = {r.request_id: r.context for r in line_context(files, requests).collect()}
    for request, path, line, radius in asked:
        assert got[request] == brute_context(texts[path], line, radius), request


def test_salted_join_spreads_a_hot_key(spark):
    rows = [("hot", i) for i in range(6000)] + [(f"k{i % 2000}", i) for i in range(6000)] + [(None, 1)]
    big = spark.createDataFrame(rows, "k string, v int").repartition(6)
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), ("gone", 4), (None, 5)], "k string, w int")
    assert hot_keys(big, "k") == ["hot"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = salted_join(big, few, "k")
        assert sorted(map(tuple, met.select("k", "v", "w").collect())) == sorted((k, v, w) for k, v in rows for j, w in [("hot", 1), ("hot", 2), ("k7", 3)] if j == k)
        loads = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(loads) == 4 and max(loads) < 0.5 * sum(loads)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert hot_keys(big.limit(0), "k") == [] and salted_join(big.limit(0), few, "k").count() == 0


def test_file_head(spark):
    files = spark.createDataFrame([("five", " a\nb\n\nd\n e"), ("four", "a\nb\nc\nd\n"), ("known", "x")], "file_path string, text string")
    indexed = spark.createDataFrame([("known",)], "file_path string")
    asked = spark.createDataFrame([("five",), ("four",), ("known",), ("lost",)], "file_path string")
    got = {r.file_path: (r.error, r.head, r.source) for r in file_head(files, indexed, asked).collect()}
    assert got == {
        "five": ("File not indexed", ["a", "b", "", "d", "e"], "fallback"),
        "four": ("Could not read file: ", None, None),
        "lost": ("Could not read file: [Errno 2] No such file or directory: 'lost'", None, None),
    }


def test_file_summary_for_requests(spark):
    files = spark.createDataFrame([("a.py", "a", None), ("b.py", "b", None)], "file_path string, module_path string, summary string")
    symbols = spark.createDataFrame(
        [("a.py", "class", 1, "C"), ("a.py", "method", 2, "m"), ("a.py", "import", 0, "os"), ("b.py", "file", 0, "b.py")],
        "file_path string, kind string, ordinal int, name string",
    )
    asked = spark.createDataFrame([("a.py",)], "file_path string")
    got = file_summary(files, symbols, asked).collect()
    assert sorted((r.section, r.ordinal, r.name, r.module_path) for r in got) == [("classes", 1, "C", "a"), ("imports", 0, "os", "a")]
    assert file_summary(files, symbols).filter("file_path = 'b.py'").select("section", "name").collect() == [(None, None)]


def test_touches_model(spark):
    symbols = spark.createDataFrame([("M", "m.M", "model"), ("v", "v.v", "view"), ("a", "a.a", "class"), ("s", "s.s", "function")], "name string, qualified_name string, kind string")
    edges = spark.createDataFrame(
        [("v.v", "m.M", "registers"), ("a.a", "m.M", "registers"), ("s.s", "m.M", "handles_signal"), ("s.s", "m.M", "calls"), ("m.M", "a.a", "calls")],
        "from_qualified string, to_qualified string, relation string",
    )
    asked = spark.createDataFrame([("r", "M"), ("n", "a")], "request_id string, model_name string")
    assert sorted(tuple(r) for r in touches_model(symbols, edges, asked).collect()) == [
        ("r", "admin", "a.a", "registers"),
        ("r", "references", "s.s", "calls"),
        ("r", "signals", "s.s", "handles_signal"),
        ("r", "views", "v.v", "registers"),
    ]


def brute_path(edges, names, source, target, depth):
    if source not in names or target not in names:
        return []
    best, seen, level = [], {source}, {source: []}
    for _ in range(depth):
        grown = {}
        for f, t, r in edges:
            if f in level:
                path = level[f] + [(t, r)]
                grown[t] = min(grown.get(t, path), path)
        if target in grown:
            return grown[target]
        level = {n: p for n, p in grown.items() if n not in seen}
        seen |= set(level)
    return best


@pytest.mark.parametrize("seed, n_edges", [(5, 55), (6, 40), (7, 90)])
def test_paths_equal_brute_force(spark, seed, n_edges):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(30)]
    edges = sorted({(rng.choice(names), rng.choice(names[:25]), rng.choice(["calls", "imports"])) for _ in range(n_edges)})
    edges += [("n3", "n3", "calls"), ("n3", "n3", "also")]  # the shortest cycle is one edge
    # a hot source, a hot target, unknown and null ends, an end nothing leads to
    pairs = [(a, b) for a in names[:8] for b in names[:6] + names[24:27]] + [("n1", b) for b in names] + [(a, "n2") for a in names]
    pairs = sorted(set(pairs)) + [("n1", "lost"), ("lost", "n1"), (None, "n1"), ("n1", None)]
    asked = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "request_id string, from_qualified string, to_qualified string")
    table = spark.createDataFrame(edges, "from_qualified string, to_qualified string, relation string").repartition(3)
    symbols = spark.createDataFrame([(n,) for n in names], "qualified_name string")
    for depth in (6,) if seed != 5 else (0, 1, 2, 5):
        got = {r.request_id: [tuple(s) for s in r.path] for r in path_between(symbols, table, asked, depth).collect()}
        assert got == {f"{a}-{b}": brute_path(edges, set(names), a, b, depth) for a, b in pairs}


def test_long_chain_is_searched_from_both_ends(spark):
    chain = [(f"c{i}", f"c{i + 1}", "calls") for i in range(12)]
    table = spark.createDataFrame(chain, "from_qualified string, to_qualified string, relation string")
    symbols = spark.createDataFrame([(f"c{i}",) for i in range(13)], "qualified_name string")
    asked = spark.createDataFrame([("ten", "c0", "c10"), ("eleven", "c0", "c11"), ("back", "c3", "c0")], "request_id string, from_qualified string, to_qualified string")
    got = {r.request_id: [s.symbol for s in r.path] for r in path_between(symbols, table, asked, 10).collect()}
    assert got == {"ten": [f"c{i}" for i in range(1, 11)], "eleven": [], "back": []}


def test_edges_off_every_path_take_no_part(spark, monkeypatch):
    """Nothing leads to the buyers of a hub, so no level of the search holds them; a frontier counts by the edges ahead of it."""
    edges = [("a", "hub", None), ("a", "hub", "calls"), ("hub", "b", "calls"), ("b", "c", "calls")] + [(f"buyer{i}", "hub", "calls") for i in range(50)]
    edges += [("a", f"dead{i}", "calls") for i in range(50)]
    sizes, write = {}, shortest_path.cut

    def counted(df, label):
        table = write(df, label)
        sizes.setdefault(label, []).append(table.count())
        return table

    monkeypatch.setattr(shortest_path, "cut", counted)
    names = sorted({n for f, t, _ in edges for n in (f, t)})
    asked = spark.createDataFrame([("r", "a", "c")], "request_id string, from_qualified string, to_qualified string")
    table = spark.createDataFrame(edges, "from_qualified string, to_qualified string, relation string")
    found = path_between(spark.createDataFrame([(n,) for n in names], "qualified_name string"), table, asked).collect()
    assert [tuple(s) for s in found[0].path] == [("hub", None), ("b", "calls"), ("c", "calls")]
    assert max(sizes["path-forward"] + sizes["path-backward"]) <= 2


def test_short_paths_need_no_search(spark, monkeypatch):
    """Paths of one and two edges come from the edges at the ends alone; for the other pairs no size check runs a job of its own."""
    edges = [("s", "s", "also"), ("s", "p2", "calls"), ("s", "p10", None), ("s", "p10", "calls"), ("p10", "t", "uses"), ("p10", "t", None), ("p2", "t", "calls")]
    edges += [(f"x{i}", "t", "calls") for i in range(9)] + [("p2", "s", "calls"), ("t", "s", "calls"), ("s", None, "calls"), (None, "t", "calls")]
    table = spark.createDataFrame(edges * 2, "from_qualified string, to_qualified string, relation string")
    symbols = spark.createDataFrame([(n,) for n in ("s", "t", "p2", "p10", "x1", "x2")], "qualified_name string")
    ends = [("s", "t"), ("s", "s"), ("p2", "p2"), ("t", "p2"), ("x1", "t"), ("x1", "s"), ("x1", "x2"), ("s", "p10")]
    asked = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in ends], "request_id string, from_qualified string, to_qualified string")
    labels, write = [], shortest_path.cut
    monkeypatch.setattr(shortest_path, "cut", lambda df, label: labels.append(label) or write(df, label))
    got = {r.request_id: [tuple(s) for s in r.path] for r in path_between(symbols, table, asked, 3).collect()}
    assert got == {
        "s-t": [("p10", None), ("t", None)],
        "s-s": [("s", "also")],
        "p2-p2": [("s", "calls"), ("p2", "calls")],
        "t-p2": [("s", "calls"), ("p2", "calls")],
        "x1-t": [("t", "calls")],
        "x1-s": [("t", "calls"), ("s", "calls")],
        "x1-x2": [],
        "s-p10": [("p10", None)],
    }
    assert "path-links" not in labels and "path-codes" not in labels
    one = {r.request_id: len(r.path) for r in path_between(symbols, table, asked, 1).collect()}
    assert one == {"s-t": 0, "s-s": 1, "p2-p2": 0, "t-p2": 0, "x1-t": 1, "x1-s": 0, "x1-x2": 0, "s-p10": 1}


def test_paths_are_the_same_with_large_tables(spark, monkeypatch):
    """Nothing is small enough to be broadcast, the last nodes are not looked for, and pairs without links at both ends are not searched."""
    rng = random.Random(8)
    names = [f"n{i}" for i in range(40)]
    edges = sorted({(rng.choice(names[:36]), rng.choice(names[4:]), rng.choice(["calls", "imports"])) for _ in range(70)})
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(120)})
    asked = spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "request_id string, from_qualified string, to_qualified string")
    table = spark.createDataFrame(edges, "from_qualified string, to_qualified string, relation string")
    symbols = spark.createDataFrame([(n,) for n in names], "qualified_name string")
    kept, write = {}, shortest_path._kept

    def counted(df, label, text=None):
        made = write(df, label, text)
        kept.setdefault(label, []).append(made.rows)
        return made

    monkeypatch.setattr(shortest_path, "_kept", counted)
    monkeypatch.setattr(shortest_path, "NAMED_ROWS", 1)
    monkeypatch.setattr(shortest_path, "HASHED_ROWS", 0)
    got = {r.request_id: [tuple(s) for s in r.path] for r in path_between(symbols, table, asked, 5).collect()}
    assert got == {f"{a}-{b}": brute_path(edges, set(names), a, b, 5) for a, b in pairs}
    starts, ends = {f for f, _, _ in edges}, {t for _, t, _ in edges}
    assert kept["path-pending"][0] <= sum(a in starts and b in ends for a, b in pairs)


def test_text_travels_once_for_context(spark, monkeypatch):
    """Many files: no join moves a text to find its size, and of a long file only the blocks asked for reach the join."""
    from skein.operators import context

    monkeypatch.setattr(context, "fits_broadcast", lambda df: False)
    joins = []
    join = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda self, other, *a, **k: joins.append((self, a)) or join(self, other, *a, **k))
    files = spark.createDataFrame([(f"f{i}", "\n".join(f"line {n}" for n in range(1, 641))) for i in range(20)], "file_path string, text string")
    asked = spark.createDataFrame([(f"r{i}", f"f{i}", 130, 1) for i in range(10)] + [("lost", "gone", 1, 1)], "request_id string, file_path string, line int, radius int")
    got = {r.request_id: r.context for r in line_context(files, asked).collect()}
    assert got == {f"r{i}": "129: line 129\n130: line 130\n131: line 131" for i in range(10)} | {"lost": "Error reading file: [Errno 2] No such file or directory: 'gone'"}
    assert not [a for df, a in joins if "text" in df.columns]
    (blocks,) = [df for df, a in joins if "lines" in df.columns and a and isinstance(a[0], list)]
    assert blocks.count() < 20


def test_semantic_equals_numpy(spark, monkeypatch):
    from skein.operators import semantic

    monkeypatch.setattr(semantic, "QUERY_BLOCK", 10)
    monkeypatch.setattr(semantic, "VECTOR_BLOCK", 200)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8)).astype("float32")
    vectors[10:40] = vectors[5]  # ties
    vectors[50] = 0
    queries = np.vstack([vectors[5], rng.normal(size=(4, 8))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", q.tolist()) for i, q in enumerate(queries)], "request_id string, embedding array<double>")
    got = search_semantic(table, asked, 7).collect()
    unit = vectors.astype(float) / np.maximum(np.linalg.norm(vectors.astype(float), axis=1, keepdims=True), 1e-30)
    for i, q in enumerate(queries):
        scores = np.round(unit @ (q / np.linalg.norm(q)), 12)
        order = [j for j in sorted(range(300), key=lambda j: (-scores[j], j)) if j != 50][:7]
        assert [r.vec_id for r in sorted((r for r in got if r.request_id == f"q{i}"), key=lambda r: r["rank"])] == order
    assert search_semantic(table, asked, 0).count() == 0


def test_semantic_blocks_and_tiles_keep_ties_in_order(spark, monkeypatch):
    from skein.operators import semantic

    rng = np.random.default_rng(8)
    vectors = rng.integers(-1, 2, (500, 3)).astype(float)  # few directions: most scores are ties
    queries = rng.integers(-2, 3, (30, 3)).astype(float)
    score = semantic._block_product(6)
    names = ["query", "vec_id", "score"]
    unit = [v / np.linalg.norm(v) if v.any() else None for v in vectors]
    for tile in ((512, 4096), (7, 5), (1, 500)):
        monkeypatch.setattr(semantic, "_TILE", tile)
        shuffled = rng.permutation(500)
        table = pa.table({"vec_id": pa.array(shuffled), "embedding": pa.array(vectors[shuffled].tolist(), pa.list_(pa.float64()))})
        asked = pa.table({"query": pa.array(range(30)), "embedding": pa.array(queries.tolist(), pa.list_(pa.float64()))})
        got = score(asked, table)
        assert got.column_names == names
        found: dict[int, list] = {}
        for row in got.to_pylist():
            found.setdefault(row["query"], []).append((row["vec_id"], row["score"]))
        for i, q in enumerate(queries):
            if not q.any():
                assert i not in found
                continue
            scores = {j: round(float(u @ (q / np.linalg.norm(q))), 9) for j, u in enumerate(unit) if u is not None}
            assert [j for j, _ in found[i]] == sorted(scores, key=lambda j: (-scores[j], j))[:6]
    assert score(asked.slice(0, 0), table).num_rows == score(asked, table.slice(0, 0)).num_rows == 0


def test_semantic_odd_rows(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([("a", [2.0, 0.0], 0), ("z", [0.0, 0.0], 0), (None, [0.0, 1.0], 1), ("n", None, 2)], "request_id string, embedding array<float>, block int")
    got = [(r.request_id, r.vec_id, r.score, r["rank"]) for r in search_semantic(table, asked, 3).collect()]
    assert sorted(got, key=repr) == sorted([("a", 1, 1.0, 1), ("a", 1, 1.0, 2), ("a", 4, -1.0, 3), (None, 1, 0.0, 1), (None, 1, 0.0, 2), (None, 4, 0.0, 3)], key=repr)
    assert search_semantic(table.limit(0), asked).count() == search_semantic(table, asked.limit(0)).count() == 0
