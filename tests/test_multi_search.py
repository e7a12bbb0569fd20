"""The automaton over many patterns, and posting lists of names, against brute force."""

from __future__ import annotations

import random
import re

import pytest

from skein.functions.patterns import basic_to_java
from skein.operators.grep import grep, grep_requests
from skein.operators import grep as grep_module, multi_search, name_index
from skein.operators.multi_search import Held, Matcher, _Page, _search, literal_of, read_expression, required_literal
from skein.operators.name_index import name_grams
from skein.operators.symbol_search import search_substring
from skein.schemas import SYMBOLS, conform


@pytest.mark.parametrize(
    "pattern, literal",
    [
        ("abc", "abc"), ("ab*cd", "cd"), ("ab?cde", "cde"), ("ab+c", "ab"), ("ab{0,2}cd", "cd"), ("ab{2}c", "ab"), ("a|bcd", ""), ("(abc)d", "d"),
        ("(abc)?de", "de"), ("x[abc]yz", "yz"), (r"\bfoo\.bar\d+", "foo.bar"), ("(?i)abc", ""), (r"\Qa.b\E", ""), (".*", ""), ("^The$", "The"),
        ("a.bcd.e", "bcd"), (r"\(call\)", "(call)"), ("[a-z]*", ""), ("ab*?cdef", "cdef"), ("x[[:alpha:]]+yy", "yy"), ("a{,3}bc", "bc"),
    ],
)
def test_required_literal(pattern, literal):
    assert required_literal(pattern) == literal


def test_every_match_holds_the_literal():
    rng = random.Random(4)
    parts = ["a", "b", "ab", ".", "[ab]", "a*", "b+", "c?", "(ab)", "(a)*", r"\.", "c{2}", "b{0,1}", "^", "$"]
    for _ in range(3000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        literal = required_literal(pattern)
        text = "".join(rng.choice("abc.") for _ in range(12))
        if re.search(pattern, text):
            assert literal in text, (pattern, text)


def test_matcher_finds_all_lines():
    rng = random.Random(1)
    patterns = ["a", "ab", "ba", "abab", "c", "", "zz", "a\nb", "µ"]
    matcher = Matcher([(p, *literal_of(p, "literal")) for p in patterns])
    for _ in range(200):
        text = "".join(rng.choice("abcµ\n") for _ in range(rng.randint(0, 60)))
        lines = text.split("\n")
        if lines[-1] == "":
            lines.pop()
        for most in (None, 1, 3):
            got = matcher.lines(lines, text, most, lambda i: True)
            for i, p in enumerate(patterns):
                assert got.get(i, []) == [k for k, line in enumerate(lines) if p in line][:most], (p, text)
    assert Matcher([]).lines(["x"], "x", None, lambda i: True) == {}


def test_held_keeps_the_first_places():
    held, want = Held(3), []
    rng = random.Random(2)
    for path in rng.sample([f"f{i:02}" for i in range(40)], 40):
        numbers = sorted(rng.sample(range(9), rng.randint(1, 3)))
        want += [(path, n + 1) for n in numbers]
        if held.wants(path)(0):
            held.add(0, path, numbers, [f"{path}:{n}" for n in range(9)])
    rows = list(held.rows([("p", "p", None)]))
    assert [r[1:3] for r in rows] == sorted(want)[:3]
    assert [r[3] for r in rows] == [f"{path}:{n - 1}" for path, n in sorted(want)[:3]] and held.size == 0


def corpus(spark):
    rng = random.Random(6)
    words = ["get", "set", "user", "get_user", "x.y", "(a)", "the", "The"]
    rows = [(f"d{i % 7}/f{i}.py", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 12)))) for i in range(90)]
    rows += [("bin.py", "get\0"), ("empty.py", ""), ("long.py", "get user " * 20_000)]
    return spark.createDataFrame(rows, "file_path string, text string").repartition(5)


@pytest.mark.parametrize("limit", [None, 0, 1, 7])
def test_requests_equal_single_searches(spark, limit):
    files = corpus(spark)
    patterns = ["get", "user", "e", "^The", r"x\.y", "[xy].y", "get_*user", "nothing", "[a-z]", r"\(a\)", "", "get.*set"]
    asked = spark.createDataFrame([(p, p) for p in patterns] + [("again", "get"), ("null", None)], "request_id string, pattern string")
    got = grep_requests(files, asked, limit=limit, dialect="java").collect()
    for p in [*patterns, "again"]:
        want = [(r.file_path, r.line_start, r.match_text) for r in grep(files, "get" if p == "again" else p, limit=limit).collect()]
        assert sorted((r.file_path, r.line_start, r.match_text) for r in got if r.request_id == p) == sorted(want), p
    assert not [r for r in got if r.request_id == "null"]
    basic = spark.createDataFrame([(p, p) for p in (r"\(get\|set\)_", "(a)", r"us*er\+")], "request_id string, pattern string")
    for r in grep_requests(files, basic, limit=limit, dialect="basic").collect():
        assert re.search(basic_to_java(r.request_id).removeprefix("(?d)"), r.match_text)


def test_numbered_names_are_looked_up_by_long_grams(spark, monkeypatch):
    """Requests for names that share all short grams read lists of a few names each, not of all."""
    lists = {}
    write = name_index.cut

    def kept(df, label):
        lists[label] = write(df, label)
        return lists[label]

    monkeypatch.setattr(name_index, "cut", kept)
    names = [f"Customer#{i:09}" for i in range(2000)] + ["x" * 100 + "Customer#000000007", None]
    rows = [(n, f"q{i:05}", "view", "f", 1, "s") for i, n in enumerate(names)]
    symbols = conform(spark.createDataFrame(rows, "name string, qualified_name string, kind string, file_path string, line_start int, summary string"), SYMBOLS)
    asked = [(n.lower(), n.lower(), None) for n in names[:2000]] + [("%tomer#0000000_7", "%tomer#0000000_7", None), ("x" * 60, "x" * 60, None), ("comer#", "comer#", None)]
    requests = spark.createDataFrame(asked, "request_id string, name string, kind string")
    got = {}
    for row in search_substring(symbols, requests, limit=None).collect():
        got.setdefault(row.request_id, []).append(row.qualified_name)
    want = {n.lower(): [f"q{i:05}"] for i, n in enumerate(names[:2000])}
    want["customer#000000007"] = ["q00007", "q02000"]
    want["%tomer#0000000_7"] = [f"q{i:05}" for i in range(7, 100, 10)] + ["q02000"]
    want["x" * 60] = ["q02000"]
    assert {k: sorted(v) for k, v in got.items()} == want
    read = lists["rarest-grams"].filter("asked like 'customer%'").join(lists["postings"], "gram").count()
    assert read < 3 * 2000


NAMES = ["get", "get_user", "getXuser", "GetUser", "User", "user", "u", "ab", "a\\b", "100%", "Übung", "", "x_y", None, "\U0001f600ab", "aaaa"]


@pytest.mark.parametrize("published", [False, True])
@pytest.mark.parametrize("limit", [None, 2])
def test_substring_equals_brute_force(spark, published, limit):
    rows = [(n, f"m{(7 * i + k) % 50:02}.{n}", kind, "f", k, "s") for k, kind in enumerate(["function", "class", None]) for i, n in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "name string, qualified_name string, kind string, file_path string, line_start int, summary string")
    symbols = conform(df, SYMBOLS)
    asked = ["get", "user", "u", "ab", "%", "_", "____", "g_t", "a%b", "t_u", "\\", "zzz", "", "GET%er", "x_y", "übu", "aa", "\U0001f600", "%%_"]
    requests = [(f"{a}|{k}", a, k) for a in asked for k in (None, "class")]
    got = search_substring(
        symbols, spark.createDataFrame(requests, "request_id string, name string, kind string"), limit=limit, postings=name_grams(symbols) if published else None
    ).collect()
    for request, a, kind in requests:
        body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in a.lower())
        want = sorted(q for n, q, k, *_ in rows if n is not None and re.search(body, n.lower(), re.S) and (kind is None or k == kind))
        assert sorted(r.qualified_name for r in got if r.request_id == request) == want[:limit], request


def test_expressions_are_read_as_spark_does(spark):
    """What Python decides is what Java's engine decides; anything doubtful is left to it."""
    rng = random.Random(8)
    parts = ["a", "b", "é", " ", ".", "[ab]", "[^a]", "[a-c,]", "a*", "b+", "c?", "(ab)", "(ab)*", r"\.", r"\ ", "c{2}", "b{0,1}", r"\w", r"\s*", r"\d", r"[\p{Upper}]", r"[\]-]", r"[\p{Punct}b]+"]
    patterns = sorted({rng.choice(["", "^", "(?d)", "(?d)^"]) + "".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", "$"]) for _ in range(250)})
    lines = ["".join(rng.choice("abcé. A1]-\u2028\r") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    read = {p: read_expression(p) for p in patterns}
    assert sum(r is not None for r in read.values()) > 150
    pairs = [(p, line) for p, r in read.items() if r for line in lines]
    by_java = spark.createDataFrame(pairs, "pattern string, line string").selectExpr("line rlike pattern").collect()
    for (p, line), (want,) in zip(pairs, by_java):
        r = read[p]
        assert bool((re.match if r.anchored else re.search)(r.expression, line, re.ASCII)) == want, (p, line)
        assert not want or any(line.startswith(s) if r.anchored else s in line for s in r.starts), (p, line)
        assert not r.certain or want == any(line.startswith(s) if r.anchored else s in line for s in r.starts), (p, line)
    for p in (r"\bab", "a|b", "(?i)a", "a*?", "a*+", r"\Qa\E", "[a&&b]", "[a[b]]", "a$b", "x^", "$", "(", "[b-a]", r"(a)\1"):
        assert read_expression(p) is None, p


class Given:
    number = 0

    def __init__(self, value):
        self.value = value

    __hash__ = object.__hash__


def searched(patterns, files, most, size=10_000):
    """Rows that one task gives out."""
    import pyarrow as pa

    table = pa.table({"file_path": [f[0] for f in files], "text": [f[1] for f in files]}, pa.schema([("file_path", pa.string()), ("text", pa.string())]))
    page = Given([(p, *literal_of(p, "basic")) for p in patterns])
    return [row for batch in _search(page, most)(table.to_batches(size)) for row in batch.to_pylist()]


@pytest.mark.parametrize("most", [1, 3])
def test_a_task_gives_out_the_first_places_of_an_expression(most):
    rng = random.Random(3)
    files = [(f"f{i:03}", "\n".join(" ".join(rng.choice(["get", "set,", "set;", "user"]) for _ in range(6)) for _ in range(5))) for i in range(300)]
    rng.shuffle(files)
    files.append((None, "get\nset, x"))
    patterns = ["^get ", "set[,;] [a-z]*", "user", "get", "^[gs]et", "r get", "nothing[,;]"]
    for size in (1000, 64):
        rows = searched(patterns, files, most, size)
        assert len(rows) <= most * len(patterns)
        assert all(r["regex"] is None for r in rows)
        for p in patterns:
            want = sorted((f or "", n + 1) for f, text in files for n, line in enumerate(text.split("\n")) if re.search(p, line))
            assert sorted((r["file_path"] or "", r["line_start"]) for r in rows if r["pattern"] == p) == want[:most], p


def test_patterns_that_have_their_places_leave_the_walk(monkeypatch):
    walked = []
    monkeypatch.setattr(Matcher, "only", lambda self, ids, only=Matcher.only: walked.append(len(ids)) or only(self, ids))
    files = [(f"f{i:03}", "one two three four\nfive six") for i in range(200)]
    rows = searched(["one", "two", "three", "four", "five", "six", "none"], files, 2)
    assert len(rows) == 12 and walked and min(walked) == 1


def test_a_pattern_with_its_places_and_many_hits_leaves_the_walk(monkeypatch):
    """One common word among many rare ones is not met all over the files that follow."""
    walked = []
    monkeypatch.setattr(Matcher, "only", lambda self, ids, only=Matcher.only: walked.append(len(ids)) or only(self, ids))
    rare = [f"rare{i:02}" for i in range(50)]
    files = [(f"f{i:03}", "common " * 400 + "\n" + rare[i % 50] * (i < 50)) for i in range(200)]
    rows = searched(["common", *rare], files, 2)
    assert len(rows) == 52 and walked == [50]


def test_tasks_leave_out_places_behind_the_bar(spark, monkeypatch):
    """A share of the files tells how far the first places reach; many tasks do not give out the limit each, and the answers are those of single searches."""
    kept = {}

    def write(df, label, cut=multi_search.cut):
        kept[label] = cut(df, label)
        return kept[label]

    monkeypatch.setattr(multi_search, "cut", write)
    rng = random.Random(9)
    rows = [(f"d{i:04}", "\n".join(rng.choice(["get user", "set user", "get, x1", "x"]) for _ in range(4))) for i in range(1000)]
    rows += [("d0000", "get once more"), ("d0990", "late\nlate"), ("d0995", "late"), (None, "get none"), ("d0500", None)]
    files = spark.createDataFrame(rows, "file_path string, text string").repartition(40)
    patterns = ["get", "user", "late", "^get,", r"\buser\b", "nothing", "[0-9]"]
    asked = spark.createDataFrame([(p, p) for p in patterns], "request_id string, pattern string")
    got = grep_requests(files, asked, limit=5).collect()
    assert kept["grep-found"].filter("pattern = 'get'").count() < 40 * 5 / 2
    for p in patterns:
        want = [(r.file_path, r.line_start) for r in grep(files, p, limit=5).collect() if r.file_path is not None]
        assert sorted((r.file_path, r.line_start) for r in got if r.request_id == p) == sorted(want), p


def test_only_lines_that_are_shown_are_joined(spark, monkeypatch):
    places = []
    monkeypatch.setattr(grep_module, "semi_join_by_size", lambda big, keys, on, join=grep_module.semi_join_by_size: places.append(keys.count()) or join(big, keys, on))
    files = spark.createDataFrame([(f"f{i:03}", "get\nget") for i in range(100)], "file_path string, text string").repartition(10)
    asked = spark.createDataFrame([("r", "get")], "request_id string, pattern string")
    assert len(grep_requests(files, asked, limit=3).collect()) == 3 and places == [3]
