import html as H
import math
import random
import re
import time
from html.parser import HTMLParser

import pytest

from weftline.llm import html_extract as X
from weftline.llm.html_extract import extract, main_text


def article_of(page):
    """The article element of the example pages, which nest nothing but paragraphs."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    body = re.sub(r"</?(p|h1|h2|li|ul|div)[^>]*>", "\n\n", body).replace("<br>", " ")
    blocks = (" ".join(H.unescape(b).split()) for b in re.sub(r"<[^>]*>", "", body).split("\n\n"))
    return "\n".join(b for b in blocks if b)


def test_equals_the_article_of_every_page(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    expected = {r["page_id"]: (r["url"], article_of(r["html"])) for r in pages.collect()}
    got = {r["page_id"]: r for r in extract(pages).collect()}
    assert {k: (r["url"], r["text"]) for k, r in got.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


LONG = "word " * 60
PAGES = [
    ("plain text", "plain text"),
    ("<p>a&amp;b &lt;c&gt;<br>d</p><p> e\n f </p>", "a&b <c> d\ne f"),
    (f"<nav><a href=x>Menu</a></nav><div class=sidebar>{LONG}</div><div id=main><h1>T</h1><p>{LONG}</p></div><footer>foot</footer>", f"T\n{LONG.strip()}"),
    (f"<div class='cookie-notice'>We use cookies</div><article><h1>T</h1><p>{LONG}<ul><li>one<li>two</ul></article><form>Name<input></form>", f"T\n{LONG.strip()}\none\ntwo"),
    (f"<article><h1>T</h1><p>{LONG}</p></article><section class=comments><article class=comment><p>{LONG * 3}</p></article></section>", f"T\n{LONG.strip()}"),
    (f"<div><p>{LONG}</p><div class=ad>Buy</div><script>if (a<b) x('</p>')</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p></div>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<header><a href=/>Site</a></header><main><header><h1>T</h1></header><p>{LONG}</p></main>", f"T\n{LONG.strip()}"),
    (f"<article><p>{LONG}<b>bold<p>next</b> one", f"{LONG.strip()} bold\nnext one"),
    ("<div><p>a < b and c > d</p></div>", "a < b and c > d"),
    ("<p title=\"x>y\">t</p>", "t"),
    ("<script>never closed", ""),
    ("<p>x &lt<i>;</i></p>", "x <;"),
    ("text > more <!-- gone", "text > more"),
    ("text > more <b", "text > more <b"),
    (f"<main><p>{LONG}</p><p><a href=x>A linked paragraph</a></p></main>", f"{LONG.strip()}\nA linked paragraph"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div class='responsive-banner-layout'><h2>T</h2><p>{LONG}</p></div></body>", f"T\n{LONG.strip()}"),
        (f"<body><div class='social-policy'><p>{LONG}</p><div class=share>Share it</div></div></body>", LONG.strip()),
        (f"<article><h1>T</h1><p>{LONG}</p><section id=search><p>{LONG}</p></section><div id=search>Find</div></article>", f"T\n{LONG.strip()}\n{LONG.strip()}"),
        (f"<article><h1>T</h1><p>{LONG}</p><div class=reader-discussion><p>{LONG}</p></div></article>", f"T\n{LONG.strip()}"),
        (f"<main><article><h1>T</h1><p>{LONG}</p></article><article><h2>Next</h2><p>A teaser.</p></article></main>", f"T\n{LONG.strip()}"),
        (f"<body><div class=sidebar><p>{LONG}</p></div><div><p>{LONG}</p></div></body>", LONG.strip()),
    ],
    ids=["wrapper named banner", "wrapper named social", "section named search", "discussion", "teaser", "sidebar"],
)
def test_names_lower_the_score_and_dont_judge(page, text):
    assert main_text(page) == text


def test_odd_pages_end_soon():
    assert main_text("<a " + '"' * 20001) is not None
    assert main_text("<b>" * 20000 + "deep") == "deep"
    assert len(main_text("<p>" + "x " * 500_000)) == 999_999


def test_edge_rows(spark):
    rows = [(None, None, None), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    out = extract(df)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0)], key=repr)
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["div", "main", "article"])
def test_density_decides_within_the_article(tag):
    links = "".join(f"<li><a href=x{i}>Another headline number {i} of this site</a></li>" for i in range(8))
    page = f"<body><{tag}><h1>T</h1><p>{LONG}</p><h3>Read next</h3><ul>{links}</ul><p>{LONG}</p></{tag}></body>"
    assert main_text(page) == f"T\n{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize(
    "page",
    ["<a " * 330_000, "x > " + "<a " * 300_000, "<i>" * 30_000 + "<div>" * 30_000, "<i>" * 60_000 + "</b>" * 60_000, "</script " * 60_000, '<p title="' + "x>" * 200_000],
    ids=["unclosed", "after a sign", "deep", "stray ends", "stray raw ends", "quote"],
)
def test_hostile_pages_take_time_in_proportion(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


class Tree(HTMLParser):
    """Nested lists [tag, children]; texts are strings."""

    def __init__(self, page):
        super().__init__()
        self.root = ["html", []]
        self.at = [self.root]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.at[-1][1].append(node := [tag, []])
        self.at.append(node)

    def handle_endtag(self, tag):
        self.at.pop()

    def handle_data(self, data):
        self.at[-1][1].append(data)


def counts(node, linked=False):
    """Characters, link characters, tags and link tags below a node."""
    linked = linked or node[0] == "a"
    c = l = t = lt = 0
    for x in node[1]:
        if isinstance(x, str):
            c, l = c + len(x.strip()), l + len(x.strip()) * linked
        else:
            c2, l2, t2, lt2 = counts(x, linked)
            c, l, t, lt = c + c2, l + l2, t + t2 + 1, lt + lt2 + (x[0] == "a")
    return c, l, t, lt


def composite(node, share, linked=False):
    c, l, t, lt = counts(node, linked)
    t = max(t, 1)
    return c / t * math.log(c / max(l, 1) * t / max(lt, 1) + 1) / math.log(math.log(c / max(c - l, 1) * l + share * c + math.e) + 1) if c else 0.0


def walk(node, linked=False):
    yield node, linked
    for x in node[1]:
        if not isinstance(x, str):
            yield from walk(x, linked or node[0] == "a")


def grown(rng, depth=0):
    """A well-formed random element."""
    tag = rng.choice(["div", "section", "p", "span", "a"] if depth else ["body"])
    inner = []
    for _ in range(rng.randrange(1, 5)):
        inner.append(grown(rng, depth + 1) if depth < 4 and tag not in ("p", "a") and rng.random() < 0.7 else "word " * rng.randrange(1, 30))
    return f"<{tag}>{''.join(inner)}</{tag}>"


def test_densities_equal_the_plain_version():
    rng = random.Random(9)
    for _ in range(60):
        page = grown(rng)
        root = Tree(page).root
        c, l, *_ = counts(root)
        nodes = list(walk(root))
        expected = [composite(node, l / max(c, 1), linked) for node, linked in nodes]
        sums = [sum(composite(x, l / max(c, 1), linked or node[0] == "a") for x in node[1] if not isinstance(x, str)) or e for (node, linked), e in zip(nodes, expected)]
        dom = X.Dom(page)
        assert dom.tags == [node[0] for node, _ in nodes]
        density, got, _ = X._densities(dom, [False] * len(dom.tags))
        assert density == pytest.approx(expected) and got == pytest.approx(sums)
        assert X._content(dom, [False] * len(dom.tags))[max(range(len(sums)), key=lambda i: (round(sums[i], 9), -i))]


def plain_selection(page):
    """Places (in page order) of the elements that are content: the subtree of the largest sum of densities without its lists
    of links below the threshold of the path to the body, and the best subtrees of all other elements that reach it."""
    root = Tree(page).root
    c, l, *_ = counts(root)
    nodes = list(walk(root))
    place = {id(node): i for i, (node, _) in enumerate(nodes)}
    density = [composite(node, l / max(c, 1), linked) for node, linked in nodes]
    inner = lambda node: [x for x in node[1] if not isinstance(x, str)]
    sums = [sum(density[place[id(x)]] for x in inner(node)) or density[place[id(node)]] for node, _ in nodes]
    parent = {place[id(x)]: place[id(node)] for node, _ in nodes for x in inner(node)}
    below = lambda i: [place[id(x)] for x, _ in walk(nodes[i][0])]
    best = sums.index(max(sums))
    path = [best]
    while path[-1] in parent:
        path.append(parent[path[-1]])
    threshold = min(density[i] for k, i in enumerate(path) if k == 0 or "body" not in [nodes[j][0][0] for j in path[: k + 1]] and i)
    taken = set(below(best))
    for i, (node, linked) in enumerate(nodes):
        nc, nl, _, nlt = counts(node, linked)
        if i in taken and i != best and node[0] in X.BLOCK and 2 * nl > nc and nlt >= X.LIST_LINKS and density[i] < threshold:
            taken -= set(below(i))
    more = set()
    for i, (node, _) in enumerate(nodes):
        above = [i]
        while above[-1] in parent:
            above.append(parent[above[-1]])
        if i and node[0] != "body" and best not in above and not more & set(above[1:]) and density[i] >= threshold > 0:
            more.add(max(below(i), key=lambda k: (sums[k], -k)))
    return taken | {k for i in more if i not in set(below(best)) for k in below(i)}


def test_selection_equals_the_plain_version():
    rng = random.Random(10)
    several = 0
    for _ in range(300):
        page = grown(rng)
        dom = X.Dom(page)
        got = {i for i, t in enumerate(X._content(dom, [False] * len(dom.tags))) if t}
        expected = plain_selection(page)
        assert got == expected, page
        several += len(got) < len(dom.tags) - 2
    assert several > 30  # the selection leaves something out
