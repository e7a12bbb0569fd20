"""Many patterns in one pass over the files.

A task builds one automaton (Aho-Corasick) over the literals of a page of patterns: a literal pattern itself, or the longest text that every match of a
regular expression holds. The automaton walks a file once and gives the lines where literals end, whatever their number. Regular expressions that mean the same in
Python are decided there and then, all others by Spark, in the same stage.

With a limit, a task reads the files of a batch in path order. A pattern that has its first places takes no part in the files after them: once half of the
patterns are done, or those that are done have had many hits, the walk goes on with an automaton of the others.

With a limit, a share of the files is searched first. Where a pattern has as many places there as the limit, the path of the last one is its bar: none of its first places
among all files lies behind it. Then all files are searched, each for the patterns whose bar it does not pass.

Patterns go to the tasks in pages of bounded size, so their number has no bound; text never leaves the stage that reads it, but for the lines of places that a
limit may still let through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from copy import copy
from functools import lru_cache, reduce
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.answers import ranked
from skein.functions.patterns import basic_to_java, is_literal
from skein.session import cut

# Patterns and bytes of one page, and places that a task holds before it gives them out.
PAGE_ROWS = 20_000
PAGE_BYTES = 4 * 1024 * 1024
HELD = 500_000
_ROWS_AT_ONCE = 10_000
# Places of a pattern that are sorted whenever one comes in, and patterns looked at for each file to find those that are done.
_SORTED_AT_ONCE = 64
_LOOKED_AT_A_FILE = 100
# Hits of patterns that are done for each pattern that is not: about what an automaton of the others costs.
_IDLE_HITS = 10
# One file in so many is searched for the bars.
BARS_FROM = 16

FOUND = "pattern string, file_path string, line_start int, text string, regex string"

# One item of a Java regular expression: an escape, a class, a character; then what repeats it.
_ITEM = re.compile(r"(?P<escape>\\.)|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<plain>.)", re.S)
_REPEAT = re.compile(r"(?:[*+?]|\{(?P<least>\d*)[^}]*\})[?+]?")


def required_literal(pattern: str) -> str:
    """The longest text that every match of a Java regular expression holds, as far as a cautious reading can tell; else empty.

    Only runs of plain and escaped characters outside of groups count. Flags inside the expression, alternatives, quotes and nested
    classes give nothing.
    """
    if pattern.startswith("(?d)"):
        pattern = pattern[4:]
    if "(?" in pattern or "\\Q" in pattern or "|" in pattern or "&&" in pattern or re.search(r"\[[^\]]*\[(?!:)", pattern):
        return ""
    best, run, depth, at = "", "", 0, 0
    while at < len(pattern):
        item = _ITEM.match(pattern, at)
        repeat = _REPEAT.match(pattern, item.end())
        at = repeat.end() if repeat else item.end()
        text = item.group()
        escape, plain = item.group("escape"), item.group("plain")
        if plain in ("(", ")"):
            depth += 1 if plain == "(" else -1
        literal = ""
        if escape and not escape[1].isalnum():
            literal = escape[1]
        elif plain and plain not in "()^$.":
            literal = plain
        if depth or not literal:
            best, run = max(best, run, key=len), ""
            continue
        if not repeat:
            run += literal
            continue
        # a repeated character stands at least once, or it may be missing; either way the run ends here
        optional = text and (repeat.group()[0] in "*?" or repeat.group("least") in ("", "0"))
        best, run = max(best, run if optional else run + literal, key=len), ""
    return max(best, run, key=len)


# POSIX classes of Java as members of a set in Python.
_POSIX_MEMBERS = {
    r"\p{Alpha}": "a-zA-Z", r"\p{Digit}": "0-9", r"\p{Alnum}": "a-zA-Z0-9", r"\p{Upper}": "A-Z", r"\p{Lower}": "a-z", r"\p{XDigit}": "0-9A-Fa-f",
    r"\p{Blank}": r" \t", r"\p{Punct}": r"!-/:-@\[-`{-~", r"\p{Print}": r" -~", r"\p{Graph}": r"!-~", r"\p{Cntrl}": r"\x00-\x1f\x7f",
}
_MEMBER = re.compile(r"(?P<posix>\\p\{\w+\})|(?P<kind>\\[wds])|(?P<one>\\[^0-9A-Za-z]|[^\\\[\]&^-])(?:-(?P<to>\\[^0-9A-Za-z]|[^\\\[\]&^-]))?", re.S)
# One atom of the expressions that are read here, then what repeats it.
_ATOM = re.compile(
    r"\\(?P<kind>[wWdDsS])|\\(?P<escape>[^0-9A-Za-z])|\[(?P<negated>\^?)(?P<set>(?:\\.|[^\\\[\]])+)\]|(?P<any>\.)|(?P<plain>[^\\\[\](){}*+?|^$.])"
    r"|(?P<open>\((?!\?))|(?P<close>\))",
    re.S,
)
_TIMES = re.compile(r"(?P<some>[*+?]|\{(?P<least>\d+)(?:,\d*)?\})(?![*+?{])")
_ENDS_LINE = r"\n\r\x85\u2028\u2029"
# Texts that the start of an expression may be spelt out to, and members of a set that is.
_MOST_STARTS, _MOST_MEMBERS = 8, 4


def _set_of(body: str, negated: str) -> tuple[str, list[str] | None] | None:
    """A Java set in Python spelling, and its members if they are few; None if it may mean something else."""
    members, alone, at = "", [], 0
    while at < len(body):
        if body[at] == "-" and at in (0, len(body) - 1):
            members, alone, at = members + r"\-", None if alone is None else [*alone, "-"], at + 1
            continue
        item = _MEMBER.match(body, at)
        if not item or item["posix"] and item["posix"] not in _POSIX_MEMBERS:
            return None
        at = item.end()
        if item["posix"] or item["kind"]:
            members, alone = members + (_POSIX_MEMBERS[item["posix"]] if item["posix"] else item["kind"]), None
            continue
        first, last = item["one"][-1], item["to"] and item["to"][-1]
        if last and last < first:
            return None
        members += re.escape(first) + (f"-{re.escape(last)}" if last else "")
        alone = None if last or alone is None else [*alone, first]
    few = alone if alone and not negated and len(alone) <= _MOST_MEMBERS else None
    return f"[{negated}{members}]", few


class Reading(NamedTuple):
    """A Java expression as Python reads it: every match starts with one of ``starts``, at the start of a line if ``anchored``, and ``certain`` says that they decide."""

    expression: str
    anchored: bool
    starts: list[str]
    certain: bool


def read_expression(java: str) -> Reading | None:
    """A Java expression that means the same in Python (with ``re.ASCII``, on lines without a line break), or None.

    Escapes of letters but for ``\\w \\d \\s``, alternatives, flags, lazy and possessive repeats, nested sets and anchors inside are left to Spark.
    """
    unix = java.startswith("(?d)")
    rest = java[4:] if unix else java
    anchored, at_end = rest.startswith("^"), False
    rest = rest[anchored:]
    if unix and rest.endswith("$") and not rest.endswith("\\$"):
        rest, at_end = rest[:-1], True
    out, starts, spelling, certain, at = "", [""], True, not at_end, 0
    while at < len(rest):
        atom = _ATOM.match(rest, at)
        if not atom:
            return None
        at = atom.end()
        grouping = atom["open"] or atom["close"]
        times = None if atom["open"] else _TIMES.match(rest, at)
        few = None
        if grouping:
            spelt = atom.group()
        elif atom["kind"]:
            spelt = atom.group()
        elif atom["any"]:
            spelt = "." if unix else f"[^{_ENDS_LINE}]"
        elif atom["set"] is not None:
            members = _set_of(atom["set"], atom["negated"])
            if members is None:
                return None
            spelt, few = members
        else:
            few = [atom["escape"] or atom["plain"]]
            spelt = re.escape(few[0])
        out += spelt
        if times:
            out += times["some"]
            at = times.end()
        if spelling and few and not times and len(starts) * len(few) <= _MOST_STARTS:
            starts = [start + member for start in starts for member in few]
            continue
        spelling = False
        # what follows the spelt start decides nothing only if it may be missing
        certain = certain and not grouping and times is not None and (times["some"] in "*?" or times["least"] == "0")
    try:
        re.compile(out, re.ASCII)
    except (re.error, OverflowError):
        return None
    return Reading(out + (r"\Z" if at_end else ""), anchored, starts, certain)


def literal_of(pattern: str, dialect: str) -> tuple[str, str | None]:
    """What the automaton looks for, and the Java expression that decides (null for a literal pattern)."""
    if is_literal(pattern, dialect):
        return pattern, None
    expression = basic_to_java(pattern) if dialect == "basic" else pattern
    return required_literal(expression), expression


# What the end of a literal says: its line is a match, a match may start there, or the line may hold one.
_SURE, _FROM_HERE, _IN_LINE = range(3)


class Matcher:
    """The automaton of a page of patterns ``(pattern, literal, expression)``."""

    def __init__(self, patterns: Sequence[tuple[str, str, str | None]]) -> None:
        self.patterns = patterns
        # the empty literal is in every line; a line break is in none
        self.everywhere = [i for i, (_, literal, _) in enumerate(patterns) if not literal]
        self.compiled: dict[int, re.Pattern] = {}
        # patterns that are decided here; Spark decides the others
        self.decided = [expression is None for _, _, expression in patterns]
        self.sought = [self._sought(i) for i in range(len(patterns))]
        self.ids: Sequence[int] = [i for i in range(len(patterns)) if self.sought[i] or not patterns[i][1]]
        self.automaton = self._automaton(self.ids)
        # ends of literals that were not wanted any more
        self.idle = 0

    def _sought(self, i: int) -> list[tuple[str, int]]:
        """The texts to look for, a line break standing for the start of a line, and what their ends say."""
        _, literal, expression = self.patterns[i]
        if not literal or "\n" in literal:
            return []
        read = None if expression is None else read_expression(expression)
        if read is None:
            return [(literal, _SURE)]
        self.decided[i] = True
        if len(read.starts[0]) + read.anchored <= len(literal) or any("\n" in start for start in read.starts):
            if read.starts == [literal] and read.certain and not read.anchored:
                return [(literal, _SURE)]
            self.compiled[i] = re.compile((r"\A" if read.anchored else "") + read.expression, re.ASCII)
            return [(literal, _IN_LINE)]
        if not read.certain:
            self.compiled[i] = re.compile(read.expression, re.ASCII)
        says = _SURE if read.certain else _FROM_HERE
        return [(("\n" if read.anchored else "") + start, says) for start in read.starts]

    def _automaton(self, ids: Iterable[int]):
        import ahocorasick

        by_text: dict[str, list[tuple[int, int, int]]] = {}
        for i in ids:
            for text, says in self.sought[i]:
                by_text.setdefault(text, []).append((i, says, len(text.lstrip("\n"))))
        if not by_text:
            return None
        automaton = ahocorasick.Automaton()
        for text, numbers in by_text.items():
            automaton.add_word(text, tuple(numbers))
        automaton.make_automaton()
        return automaton

    def only(self, ids: Sequence[int]) -> Matcher:
        """The same for some of the patterns, under their numbers here."""
        few = copy(self)
        few.ids, few.idle = ids, 0
        few.everywhere = [i for i in ids if not self.patterns[i][1]]
        few.automaton = self._automaton(ids)
        return few

    def lines(self, lines: list[str] | None, text: str, most: int | None, wanted) -> dict[int, list[int]]:
        """Numbers (from 0) of the lines that hold each pattern's literal, or a match if it is decided here; of those at most the first ``most``.

        Lines are split off when the first literal is met, unless they are given.
        """
        found: dict[int, list[int]] = {}
        if self.everywhere:
            lines = split(text) if lines is None else lines
            for i in self.everywhere:
                if wanted(i):
                    found[i] = list(range(len(lines) if most is None or self.patterns[i][2] else min(most, len(lines))))
        if self.automaton is None:
            return found
        decided, compiled, ends, line, idle = self.decided, self.compiled, None, 0, 0
        tested: dict[int, int] = {}
        # with a line break before it every line starts behind one
        for end, numbers in self.automaton.iter("\n" + text):
            if ends is None:
                lines = split(text) if lines is None else lines
                # ends of lines in the text walked
                ends = list(accumulate(len(one) + 1 for one in lines))
                ends.append(len(text) + 3)
            while end > ends[line]:
                line += 1
            for i, says, length in numbers:
                got = found.get(i)
                if got is None:
                    # an empty list of a pattern that is not wanted closes it
                    found[i] = got = [] if wanted(i) else _CLOSED
                if got is _CLOSED:
                    idle += 1
                    continue
                if got and (got[-1] == line or decided[i] and most is not None and len(got) >= most):
                    continue
                if says == _FROM_HERE:
                    start = end - length - (ends[line - 1] if line else 0)
                    if not compiled[i].match(lines[line], start):
                        continue
                elif says == _IN_LINE:
                    if tested.get(i) == line:
                        continue
                    tested[i] = line
                    if not compiled[i].search(lines[line]):
                        continue
                got.append(line)
        self.idle += idle
        return {i: numbers for i, numbers in found.items() if numbers}


_CLOSED: list[int] = []


def split(text: str) -> list[str]:
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return lines


class Held:
    """Places of literal patterns, cut to the first ``most`` of each by path and line."""

    def __init__(self, most: int | None) -> None:
        self.most = most
        self.places: dict[int, list[tuple]] = {}
        self.texts: dict[tuple, str] = {}
        # the last path that can still come in, of patterns that have all the places they may have
        self.bars: dict[int, object] = {}
        self.size = 0

    def wants(self, path):
        bars = self.bars
        return lambda i: path <= bars[i] if i in bars else True

    def open(self, ids: Iterable[int], path) -> list[int]:
        """The patterns that a file of this path, or of a later one, may have places for."""
        bars = self.bars
        return [i for i in ids if i not in bars or path <= bars[i]]

    def add(self, i: int, path, numbers: list[int], lines: list[str]) -> None:
        own = self.places.setdefault(i, [])
        for number in numbers:
            own.append((path, number))
            self.texts.setdefault((path, number), lines[number])
        self.size += len(numbers)
        # a first bar is set at once; many places are sorted again only when as many have come in
        if self.most is not None and len(own) >= (self.most if i not in self.bars or self.most <= _SORTED_AT_ONCE else 2 * self.most + 1):
            own.sort()
            self.size -= len(own) - self.most
            del own[self.most :]
            self.bars[i] = own[-1][0] if own else type(path)()

    def rows(self, patterns: Sequence[tuple]) -> Iterator[tuple]:
        """Rows of all places; the text stands in the first row of its line."""
        shown: set[tuple] = set()
        for i, places in self.places.items():
            if self.most is not None and len(places) > self.most:
                places = sorted(places)[: self.most]
            for place in places:
                yield patterns[i][0], place[0], place[1] + 1, None if place in shown else self.texts[place], None
                shown.add(place)
        self.places, self.texts, self.size = {}, {}, 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    columns[1] = [key[0] if key else None for key in columns[1]]
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["pattern", "file_path", "line_start", "text", "regex"])


@lru_cache(maxsize=1)
def _matcher(page) -> Matcher:
    """The automaton of a broadcast page; a worker keeps the last one for its next task."""
    return Matcher(page.value)


class _Page:
    """A broadcast page that is known by its number, so that a worker can tell whether it has built it already."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.number = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "number": self.number}

    def __hash__(self) -> int:
        return hash(self.number)

    def __eq__(self, other) -> bool:
        return self.number == other.number

    @property
    def value(self):
        return self.broadcast.value


def _search(page: _Page, most: int | None, bars: Broadcast | None = None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, held = _matcher(page), Held(most)
        held.bars.update(bars.value if bars else {})
        rows: list[tuple] = []
        for batch in batches:
            # a path as a tuple, the empty one for null, which comes first in Spark's order too
            keys = [() if path is None else (path,) for path in batch.column("file_path").to_pylist()]
            order = range(len(keys)) if most is None else sorted(range(len(keys)), key=keys.__getitem__)
            texts, known, due = batch.column("text"), whole, 0
            whole.idle = 0
            for at, place in enumerate(order):
                path = keys[place]
                if most is not None and (at >= due or known.idle >= _IDLE_HITS * len(known.ids)):
                    left = held.open(known.ids, path)
                    if not left:
                        break
                    if len(left) <= len(known.ids) // 2 or len(left) < len(known.ids) and known.idle >= _IDLE_HITS * len(left):
                        known = whole.only(left)
                    due = at + 1 + len(known.ids) // _LOOKED_AT_A_FILE
                text = texts[place].as_py()
                lines = None
                for i, numbers in known.lines(None, text, most, held.wants(path)).items():
                    lines = split(text) if lines is None else lines
                    if whole.decided[i]:
                        held.add(i, path, numbers, lines)
                    else:
                        pattern, _, expression = whole.patterns[i]
                        rows += [(pattern, path, number + 1, lines[number], expression) for number in numbers]
                    if len(rows) >= _ROWS_AT_ONCE:
                        yield _batch(rows)
                        rows = []
                if max(held.size, len(held.texts)) >= HELD:
                    rows += held.rows(whole.patterns)
                    yield _batch(rows)
                    rows = []
        rows += held.rows(whole.patterns)
        for first in range(0, len(rows), _ROWS_AT_ONCE):
            yield _batch(rows[first : first + _ROWS_AT_ONCE])

    return run


def pages_of(patterns: DataFrame) -> tuple[DataFrame, int]:
    """``patterns(pattern)`` with a ``page``, each of which holds a bounded number of patterns and bytes on average, and the number of pages."""
    size = patterns.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("pattern")).alias("bytes")).first()
    pages = max(1, -(-size["n"] // PAGE_ROWS), -(-(size["bytes"] or 0) // PAGE_BYTES))
    return patterns.withColumn("page", F.pmod(F.xxhash64("pattern"), F.lit(pages)).cast("int")), pages


def _places(scope: DataFrame, page: _Page, most: int | None, bars: Broadcast | None = None) -> DataFrame:
    rows = scope.select("file_path", "text").mapInArrow(_search(page, most, bars), FOUND)
    return rows.filter(F.isnull("regex") | F.rlike("text", F.col("regex"))).drop("regex")


def _bars(scope: DataFrame, page: _Page, most: int) -> dict[int, tuple]:
    """The path of the last of the first ``most`` places in a share of the files, by the number of the pattern; patterns with fewer places have none."""
    share = scope.filter(F.pmod(F.xxhash64("file_path"), F.lit(BARS_FROM)) == 0)
    places = _places(share, page, most).select("pattern", "file_path", "line_start")
    last = ranked(places, ["pattern"], ["file_path", "line_start"], most).filter(F.col("rank") == most).select("pattern", "file_path")
    paths = {pattern: () if path is None else (path,) for pattern, path in last.collect()}
    return {i: paths[r[0]] for i, r in enumerate(page.value) if r[0] in paths}


def find_literals(scope: DataFrame, patterns: DataFrame, dialect: str, most: int | None = None) -> tuple[DataFrame, list[str]]:
    """Places ``pattern, file_path, line_start, text`` of all ``patterns(pattern)`` in ``scope(file_path, text)``, and the expressions without a literal.

    Of a literal pattern, and of an expression that Python decides, every task gives out at most ``most`` places. With ``most``, places that cannot be among the first ``most`` of
    a pattern may be missing; those first ones are all there. ``text`` is null where another row has the text of the same line. Expressions that no text can be told from are
    not searched: they are answered as a list.
    """
    spark = scope.sparkSession
    paged, pages = pages_of(patterns)
    found, others = [], []
    for number in range(pages):
        asked = [row[0] for row in paged.filter(F.col("page") == number).select("pattern").collect()]
        read = [(pattern, *literal_of(pattern, dialect)) for pattern in sorted(asked)]
        others += [pattern for pattern, literal, expression in read if expression is not None and not literal]
        page = spark.sparkContext.broadcast([r for r in read if r[1] or r[2] is None])
        bars = spark.sparkContext.broadcast(_bars(scope, _Page(page), most)) if most else None
        found.append(cut(_places(scope, _Page(page), most, bars), "grep-found"))
        for used in (page, bars):
            if used is not None:
                used.unpersist()
    return reduce(DataFrame.unionByName, found), others
