"""Main text of HTML pages, by union-free regular expressions inferred from the pages of each host.

Pages of a host come from a few templates. Their block structures are aligned one after the other into one expression: the same
element again makes a repeated element, a sequence that starts over makes a repeated group, an element that some pages lack
becomes optional, and text that differs between pages becomes a slot. Below one parent each element name occurs once, so
an expression grows with the kinds of elements of a host, not with its pages.

Aligning is a merge of two expressions. Each task merges its own pages by host, salted parts of a host are merged next and
then the host's few parts, so no task ever sees all pages of a host. A join by host takes back to the pages what the expression says: which element
holds the text of pages without article and main element, and which elements are template, the same wherever they occur beside text that varies.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.page_tree import Node, at_paths, blocks, cut_paths, outermost, parse
from skein.session import cut

SALTS = 256
_HOSTS_AT_ONCE = 20_000
# An element is template when this many pages of its host have it with one text.
TEMPLATE_PAGES = 8

# An expression is a list: name, boilerplate, pages, repeated, starts over with its neighbours, characters, link characters, text (its hash above
# 200 characters) or null for a slot, children, characters outside links on pages without article or main, hash of all text inside or null where that varies.
NAME, BOILERPLATE, PAGES, REPEATED, GROUPED, CHARS, LINKS, TEXT, KIDS, PLAIN, WHOLE = range(11)


def of_page(node: Node, plain: bool | None = None) -> list:
    """The expression of one page, from the block below ``node`` on; ``plain`` when the page has neither article nor main."""
    from xxhash import xxh3_128_hexdigest

    plain = not (outermost(node, "article") or outermost(node, "main")) if plain is None else plain
    texts = [k for k in node.kids if isinstance(k, str)]
    links = [k[0] for k in node.kids if isinstance(k, tuple)]
    text = " ".join(" ".join([*texts, *links]).split())
    own = [node.name, node.boilerplate, 1, False, False, len(text), sum(map(len, links)), text if len(text) <= 200 else "\0" + xxh3_128_hexdigest(text), [], (len(text) - sum(map(len, links))) * plain, None]
    inside = [text]
    for kid in node.kids:
        if isinstance(kid, Node):
            new = of_page(kid, plain)
            if not kid.boilerplate:
                inside.append(new[WHOLE])
            _take(own[KIDS], new, 0)
    own[WHOLE] = xxh3_128_hexdigest("\0".join(inside))
    return own


def _take(kids: list, new: list, pages: int) -> None:
    """Align one more child: with the last of its name, else as a new one at the end. ``pages`` as for ``merge``."""
    for place in range(len(kids) - 1, -1, -1):
        if kids[place][NAME] == new[NAME]:
            if place == len(kids) - 1:
                kids[place][REPEATED] = True
            else:  # the sequence starts over
                for kid in kids[place:]:
                    kid[GROUPED] = True
            merge(kids[place], new, pages)
            return
    kids.append(new)


def merge(a: list, b: list, pages: int | None = None) -> list:
    """``a`` aligned with ``b``, in place. ``pages`` is how many pages ``b`` adds; all of its own if not given."""
    a[PAGES] += b[PAGES] if pages is None else pages
    a[BOILERPLATE] &= b[BOILERPLATE]
    a[REPEATED] |= b[REPEATED]
    a[GROUPED] |= b[GROUPED]
    a[CHARS] += b[CHARS]
    a[LINKS] += b[LINKS]
    a[PLAIN] += b[PLAIN]
    if a[TEXT] != b[TEXT]:
        a[TEXT] = None
    if a[WHOLE] != b[WHOLE]:
        a[WHOLE] = None
    places = {kid[NAME]: i for i, kid in enumerate(a[KIDS])}
    at = 0
    for kid in b[KIDS]:
        place = places.get(kid[NAME])
        if place is None:
            a[KIDS].insert(at, kid)
            places = {k[NAME]: i for i, k in enumerate(a[KIDS])}
            at += 1
            continue
        if place < at:  # in the other order here: both orders are one repeated group
            for between in a[KIDS][place:at]:
                between[GROUPED] = True
        merge(a[KIDS][place], kid, pages)
        at = max(at, place + 1)
    return a


def expression(own: list, pages: int | None = None) -> str:
    """The regular expression in writing: ``#`` is a text slot, ``?`` optional, ``+`` repeated, groups in brackets."""
    inner = ("#" if own[TEXT] is None else "=" if own[TEXT] else "") + _written(own[KIDS], own[PAGES])
    if not own[NAME]:
        return inner
    mark = ("+" if own[REPEATED] else "") + ("?" if pages is not None and own[PAGES] < pages else "")
    text = f"<{own[NAME]}>{inner}</{own[NAME].split('.')[0]}>"
    return f"({text}){mark}" if mark else text


def _written(kids: list, pages: int) -> str:
    out, group = [], []
    for kid in [*kids, None]:
        if kid is not None and kid[GROUPED]:
            group.append(expression(kid, pages))
            continue
        if group:
            out.append("(" + "".join(group) + ")+")
            group = []
        if kid is not None:
            out.append(expression(kid, pages))
    return "".join(out)


def _mass(own: list, slots_only: bool) -> int:
    """Characters outside links and boilerplate on pages without article or main; of slots only, if asked."""
    if own[BOILERPLATE]:
        return 0
    mine = own[PLAIN] if own[TEXT] is None or not slots_only else 0
    return mine + sum(_mass(kid, slots_only) for kid in own[KIDS])


def main_paths(own: list) -> list[list[str]]:
    """Names from the top of the element that holds the main text of those pages that have neither article nor main element.

    This is the innermost element with four fifths of their text. Text that is the same on all pages does not count, unless all is.
    """
    slots_only = own[PAGES] > 1 and _mass(own, True) > 0
    path: list[str] = []
    node, whole = own, _mass(own, slots_only)
    while True:
        heavy = [k for k in node[KIDS] if 5 * _mass(k, slots_only) >= 4 * whole and k[NAME].split(".")[0] in ("html", "body", "div", "section", "table", "tbody", "tr", "td")]
        if not whole or not heavy or heavy[0][REPEATED]:
            return [path]
        node = heavy[0]
        path = [*path, node[NAME]]


def _chars(own: list, constant: bool = False) -> tuple[int, int]:
    """Characters that vary and characters that do not in an element, boilerplate left out."""
    if own[BOILERPLATE]:
        return 0, 0
    constant |= own[WHOLE] is not None
    parts = [(0, own[CHARS]) if constant or own[TEXT] is not None else (own[CHARS], 0), *(_chars(kid, constant) for kid in own[KIDS])]
    return sum(p[0] for p in parts), sum(p[1] for p in parts)


def template_paths(own: list) -> list[list[str]]:
    """Names from the top of the outermost elements whose whole text is the same on all the pages that have them, ``TEMPLATE_PAGES`` or more.

    Text is template only beside text that varies: the element around it has more characters that vary than others, so pages
    that are copies of each other have no template. A ``h1`` is never one: parts or versions of an article share its title.
    """
    out: list[list[str]] = []
    todo: list[tuple[list[str], list]] = [([], own)]
    while todo:
        path, node = todo.pop()
        varying, same = _chars(node)
        for kid in node[KIDS]:
            here = [*path, kid[NAME]]
            if kid[WHOLE] is None:
                todo += [] if kid[BOILERPLATE] else [(here, kid)]
            elif varying > same and any(_chars(kid)) and kid[PAGES] >= TEMPLATE_PAGES and kid[NAME].split(".")[0] != "h1":
                out.append(here)
    return sorted(out)


def host_of(url: Column) -> Column:
    """Lower-case host with port of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages ``(host, html)`` to one expression per host of this task."""
    salt = TaskContext.get().partitionId() % SALTS
    known: dict[str, list] = {}

    def rows() -> pa.RecordBatch:
        columns = [list(known), [salt] * len(known), [json.dumps(w) for w in known.values()]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], ["host", "salt", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = of_page(parse(page))
            if host in known:
                merge(known[host], own)
            else:
                known[host] = own
        if len(known) > _HOSTS_AT_ONCE:
            yield rows()
            known = {}
    if known:
        yield rows()


def _merge_sorted(keys: int):
    """Rows sorted by their first ``keys`` columns, expression last, to one row per key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, names, types = None, None, None, None

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([v], t) for v, t in zip([*at, json.dumps(own)], types)], names)

        for batch in batches:
            names, types = batch.schema.names, batch.schema.types
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    if own is not None:
                        yield row()
                    at, own = key, json.loads(text)
                else:
                    merge(own, json.loads(text))
        if own is not None:
            yield row()

    return run


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper``: the expression of each host as JSON, from all of its pages."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    parts = rows.mapInArrow(_fold, "host string, salt int, wrapper string")
    parts = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    parts = parts.mapInArrow(_merge_sorted(2), "host string, salt int, wrapper string").select("host", "wrapper")
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge_sorted(1), "host string, wrapper string")


def _rules(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [json.loads(w) for w in batch.column(1).to_pylist()]
        names = pa.list_(pa.list_(pa.string()))
        columns = [batch.column(0), pa.array([main_paths(w) for w in found], names), pa.array([template_paths(w) for w in found], names), pa.array([expression(w) for w in found], pa.string())]
        yield pa.record_batch(columns, ["host", "paths", "template", "expression"])


def main_text(page: str, paths: list[list[str]], template: list[list[str]] = []) -> str:
    """The main text of one page: the blocks of its outermost articles, else of its main elements, else of the elements at ``paths``, else of
    the element that ``main_paths`` finds on the page alone; without the elements at ``template`` paths."""
    root = parse(page)
    cut_paths(root, template)
    found = outermost(root, "article") or outermost(root, "main") or at_paths(root, paths) or at_paths(root, main_paths(of_page(root)))
    return "\n".join(blocks(found))


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, paths, templates = (batch.column(i).to_pylist() for i in (2, 3, 4))
        texts = [main_text(page, p or [], t or []) for page, p, t in zip(pages, paths, templates)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text``: the main text of every row of ``pages``, from its whole HTML.

    Character references are decoded, white space inside a block is one space, blocks are joined by one line feed. Null and empty HTML
    give an empty text. Pages without a host in their URL, nulls included, are one host. Rows that repeat an id are read each; an
    empty table gives no rows; other columns are ignored.
    """
    rules = cut(host_wrappers(pages, url_col, html_col).mapInArrow(_rules, "host string, paths array<array<string>>, template array<array<string>>, expression string"), "wrappers")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"),
    )
    joined = rows.join(rules.select("host", "paths", "template"), "host", "left").select("page_id", "url", "html", "paths", "template")
    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string")
