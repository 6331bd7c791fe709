"""Main texts against plain readings of known layouts; expressions against the pages they were made from."""

import html
import random
import re

import pytest

from corpusloom.llm import page_tree, wrappers

from .fixtures import collected

SCHEMA = "page_id long, url string, html string, host string, key int, texts string, slots double"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "t", 0.5) for i, u, h in rows], SCHEMA).repartition(4)


def plain(page):
    """The article of a page of the provided tables."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = sorted(((r["page_id"], r["url"], plain(r["html"]), len(plain(r["html"]))) for r in pages.collect()), key=repr)
    assert collected(wrappers.op11_wrappers(spark, sf_dir)) == want


def sentence(r):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(4, 12))).capitalize() + "."


def site(r, i):
    """Pages of four templates and what their main texts are."""
    title, paragraphs = sentence(r), [sentence(r) for _ in range(r.randint(1, 6))]
    menu = "<ul>" + "".join(f"<li><a href=/{x}>{x}</a>" for x in "home news about".split()) + "</ul>"
    notes = "".join(f"<div class=comment><p>{sentence(r)}</div>" for _ in range(r.randint(0, 3)))
    ad = f"<div class='ad-slot box{i}'>{sentence(r)}</div>" if i % 3 else ""
    body = "".join(f"<p>{p}" for p in paragraphs)
    kind = i % 4
    if kind == 0:
        page = f"<body><header>{menu}<h2>Site</h2></header><main><article><header><h1>{title}</h1></header>{body}{ad}</article><section id=comments>{notes}</section></main><aside>{sentence(r)}</aside><footer>{i}</footer></body>"
    elif kind == 1:
        page = f"<body><div id=top-nav>{menu}</div><div class='post post-{i}'><h1>{title}</h1>{ad}{body}</div><form><p>{sentence(r)}<input></form><div class=sidebar>{sentence(r)}</div>"
    elif kind == 2:  # nothing tells the article but the host's other pages
        page = f"<body><table><tr><td>Welcome to our pages<td>{menu}</table><div><h1>{title}</h1>{body}</div><div>All rights are ours</div></body>"
        return f"http://plain.example.org/{i}", page, [title, *paragraphs]
    else:
        page = f"<body><form><div>{menu}</div><div role=main><h1>{title}</h1><div class=text>{body}</div></div><p hidden>{sentence(r)}</p></form></body>"
        page = page.replace("<form>", "<div>").replace("</form>", "</div>")
    return f"http://host{kind}.example.org/{i}?q", page, [title, *paragraphs]


@pytest.mark.parametrize("fan", [64, 3])
def test_templates(spark, fan):
    r = random.Random(4)
    made = [(i, *site(r, i)) for i in range(120)]
    got = {x["page_id"]: x["text"] for x in wrappers.main_texts(frame(spark, [m[:3] for m in made]), fan).collect()}
    assert {i: got[i].split("\n") for i, *_ in made} == {i: t for i, _, _, t in made}


def test_hard_cases(spark):
    url = "http://a.example/x"
    cases = [
        (1, url, None, ""), (2, url, "", ""), (3, None, "<p>A&amp;B &lt; c&nbsp; d", "A&B < c d"), (4, "", "no tags at all", "no tags at all"),
        (5, "x", "<article>cut <b>of", "cut of"), (None, url + "1", "<article><p>one<p>two<br>lines</article>", "one\ntwo lines"),
        (None, None, None, ""), (7, url, "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
        (8, url, "<article><script>if (a < b) { '</p>' }</script><p title='a > b'>shown</p><!-- <p>no</p> --><style>p{}</style></article>", "shown"),
        (9, url, "<article>" + "<p>" + "word " * 30000 + "</article>", ("word " * 30000).strip()), (9, url, "<article><p>again</article>", "again"), (9, url, "<article><p>again</article>", "again"),
        (10, url, "<article><p>" + "<a<a'" * 3000, None), (11, url, "<article><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "x\ny\n1\n2\n3"),
        (12, "http://b.example/", "<div class=main-header><p>site</div><form><div class=post><h2 class=entry-header>t</h2><p>x</p><form><div><p>mail</div></form></div></form><header><p>h</header>", "t\nx"),
        (13, "http://c.example/", "<form><div><p>a name</p></div><article class=post><header class=x><h1>h</h1></header>b<form><div><p>sign</div></form><div class=share>s</div></article></form>", "h\nb"),
    ]
    got = collected(wrappers.main_texts(frame(spark, [c[:3] for c in cases])))
    assert len(got) == len(cases)
    texts = sorted((g[0] is None, g[0] or 0, g[2]) for g in got if g[0] != 10)
    assert texts == sorted((c[0] is None, c[0] or 0, c[3]) for c in cases if c[0] != 10)
    assert all(g[3] == len(g[2]) for g in got)
    assert wrappers.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_of_one_article_stay(spark):
    rows = [(i, "http://copies.example/", "<div><ul><li><a>menu</a></ul></div><div><h1>Title</h1><p>All pages hold this.</p></div>") for i in range(9)]
    assert {x["text"] for x in wrappers.main_texts(frame(spark, rows)).collect()} == {"Title\nAll pages hold this."}


def shape(page):
    return page_tree.expression(wrappers.folded(page)[0])


def test_folding_and_alignment():
    assert shape("<ul><li>a<li>b<li>c</ul>") == "ul(li(#)+)"
    assert shape("<h2>a</h2><p>b<p>c<h2>d</h2><p>e") == "(h2(#) p(#)+)+"
    assert shape("<div><p>a</div><div>b</div>") == "div(p(#)? #?)+"
    one, two = (page_tree.read(page_tree.written(wrappers.folded(p)[0], False)) for p in ("<h1>a</h1><div class=x1>b</div><p>c", "<h1>a</h1><p>c<p>d<hr><pre>e</pre>"))
    assert page_tree.expression(page_tree.aligned(one, two, lambda a, b: None)) == "h1(#) div.x(#)? p(#)+ pre(#)?"
    group, single = (page_tree.read(page_tree.written(wrappers.folded(p)[0], False)) for p in ("<h2>a</h2><p>b<h2>c</h2><p>d", "<h2>a</h2><p>b"))
    assert page_tree.expression(page_tree.aligned(single, group, lambda a, b: None)) == "(h2(#) p(#))+"


def accepts(items, tokens):
    """Whether an expression stands for a list of tokens, by trying all ways."""

    def one(x, at):
        if x.items is None:
            return {at + 1} if at < len(tokens) and tokens[at] == "#" else set()
        if x.key.startswith("("):
            return run(x.items, {at})
        inner = run(x.items, {at + 1}) if at < len(tokens) and tokens[at] == "<" + x.key else set()
        return {k + 1 for k in inner if k < len(tokens) and tokens[k] == ">" + x.key}

    def run(items, places):
        for x in items:
            found = {k for p in places for k in one(x, p)}
            new = found
            while x.q & 2 and new:
                new = {k for p in new for k in one(x, p)} - found
                found |= new
            places = found | places if x.q & 1 else found
        return places

    return len(tokens) in run(items, {0})


def tokens(items):
    for x in items:
        yield from ["#"] if x.items is None else ["<" + x.key, *tokens(x.items), ">" + x.key]


def test_a_wrapper_stands_for_all_its_pages():
    r = random.Random(8)

    def tree(depth):
        if depth == 0:
            return "text"
        return "".join(r.choice(["<div>%s</div>", "<ul><li>%s</ul>", "<p>%s</p>", "<h2>t</h2>%s", "<section class=s>%s</section>"]) % tree(depth - 1) for _ in range(r.randint(1, 4)))

    for _ in range(40):
        pages = [tree(3) for _ in range(6)]
        whole = None
        for p in pages:
            own = page_tree.read(page_tree.written(wrappers.folded(p)[0], False))
            whole = own if whole is None else page_tree.aligned(whole, own, lambda a, b: None)
        for p in pages:
            assert accepts(whole, list(tokens(page_tree.parsed(p)[0])))


def test_one_wrapper_a_host(spark):
    r = random.Random(4)
    made = [(i, *site(r, i)[:2]) for i in range(60)]
    found = {x["host"]: (page_tree.expression(page_tree.read(x["wrapper"])), x["n"]) for x in wrappers.wrappers(frame(spark, made), 2).collect()}
    assert sorted(found) == ["host0.example.org", "host1.example.org", "host3.example.org", "plain.example.org"]
    assert {n for _, n in found.values()} == {15}
    assert "h1(#)? p(#)*" in found["plain.example.org"][0]
