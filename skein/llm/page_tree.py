"""Block structure of one HTML page, read leniently: what the wrapper inference aligns and the extraction walks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Element names and words of class, id and role attributes; plain values of HTML and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " tr ul noscript template button select object svg".split()
)
BOILERPLATE = frozenset(
    "head nav footer aside form button select dialog menu noscript template svg object canvas audio video".split()
)
BOILERPLATE_WORDS = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies"
    " disclaimer disqus footer form hidden login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo"
    " promoted related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar"
    " widget".split()
)
HEADER_WORDS = frozenset("header masthead".split())
_ASIDE_ARTICLES = frozenset("ad comment comments promo related reply sponsored teaser teasers".split())
# Blocks of running text: an id made from a heading, or a class that styles a paragraph, says nothing about what they are.
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote dt dd caption figcaption".split())
_ROLES = frozenset("banner complementary contentinfo navigation search form dialog alert".split())
# Opening one of the first closes an open one of the second, unless one of the third stands between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
_FENCES = frozenset("article main body table td th section".split())
# Deeper elements add their content to the element at this depth, except what is boilerplate, an article or a main element.
DEEPEST = 100

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

BREAK = None


class Node:
    """An element: its name with the words of its class and id, and texts, ``(link text,)``, breaks and nodes in page order."""

    __slots__ = ("tag", "name", "boilerplate", "by_word", "kids")

    def __init__(self, tag: str, name: str, boilerplate: bool, by_word: bool = False) -> None:
        self.tag, self.name, self.boilerplate, self.by_word = tag, name, boilerplate, by_word
        self.kids: list = []


def _describe(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """The name of an element for alignment, whether it is boilerplate by its tag or attributes, and whether words of its class or id alone say so."""
    boilerplate = tag in BOILERPLATE or tag == "header" and not in_article
    words: list[str] = []
    by_word = False
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value == "true":
                boilerplate = True
            elif key == "role":
                boilerplate |= value.lower() in _ROLES
            elif key in ("class", "id"):
                words += [w.lower() for w in _NAME.findall(value)]
        by_word = not boilerplate
        if tag not in TEXT_BLOCKS:
            boilerplate |= not BOILERPLATE_WORDS.isdisjoint(words) or not in_article and not HEADER_WORDS.isdisjoint(words)
        if tag in ("html", "body", "article", "main"):  # page-wide flags such as "has-sidebar"
            boilerplate, by_word = tag == "article" and not _ASIDE_ARTICLES.isdisjoint(words), False
    return ".".join([tag, *dict.fromkeys(words)]), boilerplate, boilerplate and by_word


def _stands_alone(node: Node, stack: list[Node]) -> bool:
    """Whether an element below ``DEEPEST`` is a node of the tree; at most one of each kind below another, so depth has a bound."""
    deep = stack[DEEPEST:]
    if node.boilerplate:
        return not any(n.boilerplate and (node.by_word or not n.by_word) for n in deep)
    return node.tag in ("article", "main") and not any(n.tag == node.tag for n in deep)


def _weigh(root: Node) -> dict[Node, tuple[int, bool, bool]]:
    """For each element outside what is boilerplate by more than words: characters outside links, and whether it has an article or a main."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node) and (k.by_word or not k.boilerplate)]
    out: dict[Node, tuple[int, bool, bool]] = {}
    for node in reversed(order):
        chars, article, main = sum(len(k.strip()) for k in node.kids if isinstance(k, str)), node.tag == "article", node.tag == "main"
        for kid in node.kids:
            if isinstance(kid, Node) and kid in out:
                more = out[kid]
                chars, article, main = chars + more[0], article or more[1], main or more[2]
        out[node] = chars, article, main
    return out


def _clear_holders(root: Node) -> None:
    """Take the mark from elements that words alone made boilerplate, where they hold the main text of the page.

    They do when they hold a main element, or more than half of the text, or articles on a page with none outside such elements;
    outer elements come first, so a list of related articles inside a cleared container stays marked.
    """
    weights = _weigh(root)
    whole = weights[root][0]
    level = [root]
    while level:
        marked, todo, clean = [], level, False
        while todo:
            node = todo.pop()
            clean |= node.tag == "article"
            for kid in node.kids:
                if kid in weights if isinstance(kid, Node) else False:
                    (marked if kid.boilerplate else todo).append(kid)
        level = [n for n in marked if weights[n][2] or 2 * weights[n][0] > whole or weights[n][1] and not clean]
        for node in level:
            node.boilerplate = node.by_word = False


def parse(page: str) -> Node:
    """The tree of a page, without marks on what holds its main text."""
    root = _tree(page)
    _clear_holders(root)
    return root


def _tree(page: str) -> Node:
    """The tree of a page. Bad markup never fails: unknown ends are ignored, open elements end where others imply it."""
    root = Node("", "", False)
    stack = [root]
    articles = links = at = 0

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            stack[-1].kids.append((piece,) if links else piece)

    def close(depth: int) -> None:
        nonlocal articles
        articles -= sum(n.tag == "article" for n in stack[depth:])
        del stack[depth:]
        if depth >= DEEPEST:
            stack[-1].kids.append(BREAK)

    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            return root
        text(page[at : token.start()])
        at = token.end()
        tag = token[2]
        if not tag:
            continue
        tag = tag.lower()
        if token[1]:
            if tag == "a":
                links = max(0, links - 1)
            depth = len(stack) - 1
            while depth and stack[depth].tag != tag:
                if stack[depth].tag in _FENCES and tag not in _FENCES and tag != "html":
                    depth = 0
                    break
                depth -= 1
            if depth:
                close(depth)
            elif tag in BLOCKS:
                stack[-1].kids.append(BREAK)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "hr":
            stack[-1].kids.append(BREAK)
            continue
        if tag in VOID:
            continue
        if tag == "a":
            links += 1
        block = tag in BLOCKS
        if block and len(stack) > 1 and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in _IMPLIED:
            ends, fence = _IMPLIED[tag]
            depth, found = len(stack) - 1, 0
            while depth and stack[depth].tag not in fence:
                if stack[depth].tag in ends:
                    found = depth
                depth -= 1
            if found:
                close(found)
        name, boilerplate, by_word = _describe(tag, token[3], articles > 0)
        if block or boilerplate:
            if token[3].endswith("/") and not block:
                continue
            node = Node(tag, name, boilerplate, by_word)
            if len(stack) < DEEPEST or _stands_alone(node, stack):
                stack[-1].kids.append(node)
            else:  # an element of its own for end tags only
                stack[-1].kids.append(BREAK)
                node.kids = stack[-1].kids
            stack.append(node)
            articles += tag == "article"


def blocks(nodes: list[Node]) -> Iterator[str]:
    """The texts of the blocks below ``nodes`` in page order, without boilerplate, white space runs as one space."""
    held: list[str] = []
    todo: list = [iter(nodes)]
    ends: list[bool] = [False]
    while todo:
        for kid in todo[-1]:
            if kid is BREAK:
                break
            if isinstance(kid, str):
                held.append(kid)
            elif isinstance(kid, tuple):
                held.append(kid[0])
            elif kid.boilerplate:
                if kid.tag in BLOCKS:
                    break
            else:
                todo.append(iter(kid.kids))
                ends.append(True)
                break
        else:
            todo.pop()
            ends.pop()
        if joined := " ".join("".join(held).split()):
            yield joined
        held = []


def outermost(root: Node, tag: str) -> list[Node]:
    """The elements of a name outside boilerplate, in page order, none inside another."""
    out: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            out.append(node)
            continue
        todo += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.boilerplate]
    return out


def at_paths(root: Node, paths: list[list[str]]) -> list[Node]:
    """The elements of a page whose names from the top are one of ``paths``, in page order, none inside another."""
    wanted = {tuple(p) for p in paths}
    ways = {p[:i] for p in wanted for i in range(1, len(p) + 1)}
    out: list[Node] = []
    todo: list[tuple[tuple, Node]] = [((), root)]
    while todo:
        path, node = todo.pop()
        if path in wanted:
            out.append(node)
            continue
        for kid in reversed([k for k in node.kids if isinstance(k, Node)]):
            if (*path, kid.name) in ways and (kid.by_word or not kid.boilerplate):  # a container on other pages is one here
                kid.boilerplate = False
                todo.append(((*path, kid.name), kid))
    return out


def cut_paths(root: Node, paths: list[list[str]]) -> None:
    """Mark the elements of a page whose names from the top are one of ``paths`` as boilerplate."""
    ways: dict = {}
    for path in paths:
        at = ways
        for name in path:
            at = at.setdefault(name, {})
    todo = [(ways, root)]
    while todo:
        at, node = todo.pop()
        for kid in node.kids:
            if isinstance(kid, Node) and kid.name in at:
                if at[kid.name]:
                    todo.append((at[kid.name], kid))
                else:
                    kid.boilerplate = True
