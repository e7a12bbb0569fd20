"""Page reading, wrapper inference and extraction."""

from __future__ import annotations

import html
import json
import random
import re

from skein.llm.html_wrappers import extract_main_text, expression, host_of, host_wrappers, main_paths, main_text, merge, of_page, template_paths
from skein.llm.page_tree import blocks, parse
from skein.llm.queries import QUERIES
from tests.llm.helpers import SF, plain


def wrapper(*pages: str) -> list:
    own = of_page(parse(pages[0]))
    for page in pages[1:]:
        merge(own, of_page(parse(page)))
    return own


def test_alignment_finds_optional_repeated_and_groups():
    a = "<body><h1>Site</h1><div class=c><p>one</p></div></body>"
    b = "<body><h1>Site</h1><p>hello</p><div class=c><p>two</p><p>three</p></div></body>"
    assert expression(wrapper(a)) == "<body><h1>=</h1><div.c><p>=</p></div></body>"
    assert expression(wrapper(a, b)) == "<body><h1>=</h1>(<p>=</p>)?<div.c>(<p>#</p>)+</div></body>"
    c = "<div><h2>x</h2><p>1</p><h2>y</h2><p>2</p><p>3</p></div>"
    assert expression(wrapper(c)) == "<div>(<h2>#</h2>(<p>#</p>)+)+</div>"
    other_order = wrapper("<div><ul>a</ul><p>b</p></div>", "<div><p>b</p><ul>a</ul></div>")
    assert expression(other_order) == "<div>(<ul>=</ul><p>=</p>)+</div>"


def test_wrapper_size_does_not_grow_with_the_pages():
    rng = random.Random(1)
    tags = ["p", "ul", "h2", "blockquote", "div class='x y'"]

    def page():
        return "<body><article>" + "".join(f"<{t}>{rng.random()}</{t.split()[0]}>" for t in rng.choices(tags, k=rng.randint(0, 40))) + "</article></body>"

    few, many = wrapper(*[page() for _ in range(30)]), wrapper(*[page() for _ in range(300)])
    assert len(json.dumps(many)) < 1.2 * len(json.dumps(few))
    assert many[2] == 300


def text(page: str) -> str:
    return main_text(page, main_paths(wrapper(page)))


def test_boilerplate_goes():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
      <nav><a href=/>Home</a></nav><div id="cookie-notice">Cookies!</div><main><article><header><h1>Title &amp; more</h1></header>
      <p>First <b>bold</b>,\n <a href=x>link</a>&nbsp;end.<span class="ad">Buy</span></p><script>var t="</p>";</script>
      <div class="ad-banner">Ad</div><ul><li>one<li>two</ul><blockquote>quoted</blockquote><table><tr><td>a<td>b</table>
      <form>Search<input></form><footer>by me</footer></article><section class="comments"><article class=comment>nice</article></section></main>
      <aside>Related</aside><footer>&copy; us</footer><noscript>js</noscript></body></html>"""
    assert text(page).split("\n") == ["Title & more", "First bold, link end.", "one", "two", "quoted", "a", "b"]


def test_pages_without_an_article():
    page = "<body><div id=menu>m</div><div id=wrap><div class=content><p>%s</p><p>%s</p></div><div class=side><a>l</a></div></div></body>"
    a, b = page % ("long text " * 20, "x"), page % ("another text " * 20, "y")
    paths = main_paths(wrapper(a, b))
    assert paths == [["body", "div.wrap", "div.content"]]
    assert main_text(b, paths) == ("another text " * 20).strip() + "\ny"
    assert main_text("<p>no such element</p>", paths) == "no such element"


def test_broken_markup_does_not_crash():
    rng = random.Random(2)
    parts = ["<p>", "</p>", "<b", "<div class='x", "\">", "</article>", "<article>", "<!--", "-->", "<script>", "</script", "&amp", "&#0;", "&#x110000;", "<", ">", "text ", "<td>", "</table>", "<li>", "\u0000", "漢"]
    for _ in range(400):
        page = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        list(blocks([parse(page)]))
        text(page)
    assert text("") == "" and text("plain") == "plain" and text("a &lt;b&gt; &eacute;&#233;") == "a <b> éé"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<p>open <b>bold<br><p>next</article><p>last") == "open bold\nnext\nlast"


def test_hosts(spark):
    urls = ["http://A.example.org:80/x?y", "https://u@b.example.org", "no url", None, "HTTP://a.example.org:80#z", ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(host_of(df.url)).collect()] == ["a.example.org:80", "b.example.org", "", "", "a.example.org:80", ""]


def test_extraction_of_odd_rows(spark):
    good = "<body><article><p>%d</p></article></body>"
    rows = [(i, f"http://h{i % 2}.org/{i}", good % i, "clash") for i in range(30)]
    rows += [(90, None, None, "c"), (91, "", "", "c"), (92, "http://h0.org", "plain", "c"), (None, "http://h1.org", good % 7, "c"), rows[3]]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, paths string").repartition(5)
    got = extract_main_text(df)
    want = [(i, u, re.sub("<[^>]*>", "", h or "")) for i, u, h, _ in rows]
    assert plain(got) == sorted(want, key=repr)
    assert got.schema["page_id"].dataType.simpleString() == "int"
    assert extract_main_text(df.limit(0)).count() == 0
    merged = {r.host: json.loads(r.wrapper) for r in host_wrappers(df).collect()}
    assert sorted(merged) == ["", "h0.org", "h1.org"] and merged["h0.org"][2] == 16 and merged["h1.org"][2] == 17


def test_html_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = []
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        found = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        body = "\n".join(b for b in found if b)
        want.append((r.page_id, r.url, body, len(body)))
    assert plain(QUERIES["op3_html_extraction"](spark, SF)) == sorted(want, key=repr)


def test_templates_of_few_pages_keep_their_article():
    common = "<body><p>top</p><article class=a>common text %d " + "word " * 100 + "</article></body>"
    rare = "<body><p>top</p><article class=b>rare text</article></body>"
    both = "<body><p>top</p><article class=a>one</article><article class=b>two</article></body>"
    by_main, plain_page = "<body><p>top</p><main>by main</main></body>", "<body><h1>x</h1><div class=c>" + "plain " * 9 + "</div></body>"
    paths = main_paths(wrapper(*[common % i for i in range(60)], rare, both, by_main, plain_page))
    assert main_text(rare, paths) == "rare text" and main_text(both, paths) == "one\ntwo"
    assert main_text(by_main, paths) == "by main" and main_text(plain_page, paths) == ("plain " * 9).strip()


def test_words_alone_do_not_remove_what_holds_the_article():
    inner = "<article><p>the article</p><div class=share-buttons>Share</div></article>"
    related = "<div class=related-posts><article>teaser</article></div>"
    for mark in ("has-sidebar", "no-comments", "overflow-hidden", "main-with-nav"):
        assert text(f"<body><div id=page class='{mark}'>{inner}{related}</div><div class=sidebar>Side</div></body>") == "the article"
    assert text("<body><div class=no-sidebar><main><p>by main</p></main></div></body>") == "by main"
    assert text("<body><div class='no-comments'><p>" + "plain " * 30 + "</p></div><div class=ad>Ad</div></body>") == ("plain " * 30).strip()
    assert text(f"<body>{inner}{related}<div hidden><article>unseen</article></div></body>") == "the article"


def test_deep_elements_keep_their_ends_and_boilerplate():
    for depth in (50, 98, 99, 100, 101, 150, 3000):
        deep = "<div>" * depth + "in<nav><div>menu</div></nav><div class=ad>Ad</div>side<form><p>form</p></form>" + "</div>" * depth
        page = f"<body><div class=c><p>{'first ' * 40}</p>{deep}<p>{'last ' * 40}</p></div><div class=foot>foot</div></body>"
        assert text(page).split("\n") == [("first " * 40).strip(), "in", "side", ("last " * 40).strip()]
        page = "<body>" + "<div>" * depth + "out<article>a<p>b</p>c<nav>menu</nav>d</article>out" + "</div>" * depth + "<p>out</p></body>"
        assert text(page).split("\n") == ["a", "b", "c", "d"]


def test_long_text_that_is_the_same_on_all_pages_is_no_slot():
    page = "<body><div class=legal>" + "terms and conditions " * 60 + "</div><div class=text>article number %d</div></body>"
    assert expression(wrapper(page % 1, page % 2)) == "<body><div.legal>=</div><div.text>#</div></body>"
    assert main_paths(wrapper(page % 1, page % 2)) == [["body", "div.text"]]
    assert main_text(page % 1, [["body", "div.text"]]) == "article number 1"


def test_words_never_cut_running_text():
    page = (
        '<html><body><nav>menu</nav><article><h2 id="login">How login works</h2><p class="search">Search trees.</p><p id="related">Kept.</p>'
        '<div class="disclaimer">legal</div><ins class="adsbygoogle">buy</ins><div class="commentlist"><p>first!</p></div></article>'
        '<article class="teaser">read on</article></body></html>'
    )
    text = main_text(page, [])
    assert "How login works" in text and "Search trees." in text and "Kept." in text
    assert not any(word in text for word in ("menu", "legal", "first!", "read on"))


def cut_by_host(pages: list[str]) -> list[str]:
    own = wrapper(*pages)
    return [main_text(page, main_paths(own), template_paths(own)) for page in pages]


def templates(i: int) -> dict[str, tuple[str, list[str]]]:
    """Page ``i`` of five templates with its main text; what is cut has no listed class, so that only the host's expression can tell."""
    body = [f"Title {i}", f"First paragraph of {i} " + "word " * (i % 5 + 3), f"Second one, {i * 7}"]
    h, a, b = body
    return {
        "article": (f"<body><article><h1>{h}</h1><p>{a}</p><p>{b}</p><div class=legal>All rights reserved by us.</div></article></body>", body),
        "main": (f"<body><main><div class=kicker>The daily paper</div><h1>{h}</h1><div class=t><p>{a}<p>{b}</div></main><div class=x>Contact</div></body>", body),
        "plain": (f"<body><div class=top>Site</div><div class=c><h1>{h}</h1><p>{a}</p><p>{b}</p><div class=box><p>Get our app</p><p>Now</p></div></div></body>", body),
        "table": (f"<body><table><tr><td class=l>Links<td class=r><h2>{h}</h2><p>{a}</p><p>{b}</p><p class=end>The end.</p></table></body>", body),
        "optional": (
            f"<body><article><h1>{h}</h1>" + ("<section class=hint><h3>Hint</h3><p>Sign in to read more</p></section>" if i % 2 else "") + f"<p>{a}</p><p>{b}</p></article></body>",
            body,
        ),
    }


def test_what_is_constant_over_a_host_is_template():
    for kind in templates(0):
        made = [templates(i)[kind] for i in range(24)]
        got = cut_by_host([page for page, _ in made])
        for text_, (_, blocks_) in zip(got, made):
            assert text_.split("\n") == [" ".join(b.split()) for b in blocks_], kind


def test_copies_and_small_hosts_have_no_template():
    page = "<body><article><h1>One title</h1><p>%s</p><div class=note>Same note</div></article></body>"
    assert cut_by_host([page % "the same text"] * 30) == ["One title\nthe same text\nSame note"] * 30
    few = cut_by_host([page % f"text number {i}" for i in range(7)])
    assert few == [f"One title\ntext number {i}\nSame note" for i in range(7)]
    short = cut_by_host([page % f"text number {i}" for i in range(8)])  # more characters that are the same than others
    assert short == [f"One title\ntext number {i}\nSame note" for i in range(8)]
    many = cut_by_host([page % f"a longer text number {i}" for i in range(8)])
    assert many == [f"One title\na longer text number {i}" for i in range(8)]  # the note goes, a shared title stays


def test_template_is_cut_in_the_query_too(spark):
    rows = [(i, f"http://{kind}.org/{i}", page, blocks_) for kind in templates(0) for i in range(16) for page, blocks_ in [templates(i)[kind]]]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id int, url string, html string").repartition(4)
    want = [(i, url, "\n".join(" ".join(b.split()) for b in blocks_)) for i, url, _, blocks_ in rows]
    assert plain(extract_main_text(df)) == sorted(want, key=repr)
