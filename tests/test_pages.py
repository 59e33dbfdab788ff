"""Parse pass, selectors, signals and extraction on small pages."""

import json

import pytest
from pyspark.sql import functions as F

from shelfspark.config import JobConfig
from shelfspark.functions import nodes as N
from shelfspark.operators.extract import GENERIC_CHAIN, SITE_CHAIN, build_products, extract_fields
from shelfspark.operators.pagination import with_lazy_signal, with_next_link
from shelfspark.operators.parse import parse_pages
from shelfspark.operators.signals import with_signals
from shelfspark.operators.taxonomy import builtin_taxonomy

URL = "https://shop.example/details/x-1"


def parsed(spark, pages, url=URL):
    rows = [(i, url, html) for i, html in enumerate(pages)]
    return parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))


def by_page(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("page_id").collect()]


def ld(*documents):
    return "".join(f'<script type="application/ld+json">{d if isinstance(d, str) else json.dumps(d)}</script>' for d in documents)


def test_tree_shape(spark):
    html = "<ul><li>one<li>two <b>x</b></ul><table><tr><td>a<td>b<tr><td>c</table><p>p1<p>p2<div>d</div><br/>t<!-- c -->u<script>no</script>"
    row = parsed(spark, [html, None, "<p>cut <b"]).orderBy("page_id").collect()[0]
    tags = [n.tag for n in row.nodes]
    assert tags == ["ul", "li", "li", "b", "table", "tr", "td", "td", "tr", "td", "p", "p", "div", "br", "script"]
    assert [row.nodes[n.parent].tag if n.parent >= 0 else None for n in row.nodes] == [
        None, "ul", "ul", "li", None, "table", "tr", "tr", "table", "tr", None, None, None, None, None]
    ul = row.nodes[0]
    assert (ul.last, ul.text_len) == (3, len("onetwox"))
    assert "no" not in row.texts and row.texts[-2:] == ["t", "u"]


def test_selectors(spark):
    html = '<div class="a  b"><p data-x="Foo Bar" id=p1><i class=t>1</i></p></div><p id=p2><i class="t">2</i></p>'
    cases = {
        "p": 2, ".a": 1, ".b p": 1, "div > i": 0, "p > i.t": 2, "[data-x]": 1, "[data-x='Foo Bar']": 1, "[data-x*='oo b']": 0,
        "[data-x*='oo b' i]": 1, "[id$='2']": 1, "[id^=p]": 2, "div i, #bad": 0, "div p i.t, [id=p2]": 2, "p:hover": 0, ".a .b": 0,
    }
    df = parsed(spark, [html]).select(*[F.size(N.select("nodes", s)).alias(s.replace(".", "_")) for s in cases])
    assert list(df.collect()[0]) == list(cases.values())


SIGNALS = {
    '<h1>a</h1><p class="price">£5</p>': (1, 1, True),
    '<p class="price">£5</p><ul><li><a href="/n">n</a><p class="price">£3</p></li></ul>': (2, 1, True),
    '<article><a href="/n">n</a><p class="price">£3</p></article>': (1, 0, False),
    "<p>nothing</p>": (0, 0, False),
    '<meta property="og:type" content="Product">': (0, 0, True),
    ld({"@type": "ItemList", "x": {"@type": "Product"}}): (0, 0, True),
    '<div itemtype="https://schema.org/product"></div>': (0, 0, True),
    '<div><div><div><div><div><a href="/n">n</a><div><div><div><div><b class="price">1</b></div></div></div></div></div></div></div></div></div>': (1, 1, True),
    "<section>" + "w " * 400 + '<a href="/n">n</a><b class="price">1</b></section>': (1, 1, True),
}


def test_signals(spark):
    assert by_page(with_signals(parsed(spark, SIGNALS)), "n_prices", "n_free", "is_product_page") == list(SIGNALS.values())


def test_own_prices(spark):
    pages = [
        '<i itemprop="price" content="53.74"></i><b class="price">9</b>',
        '<b data-price="7">x</b><b class="price">9</b>',
        '<b itemprop="price">0</b><b class="price">9</b><ul><li><a href=x>x</a><b class="price">1</b></li></ul>',
    ]
    got = by_page(with_signals(parsed(spark, pages)), "own_prices")
    assert [[float(p) for p in prices] for prices in got] == [[53.74], [7.0], [9.0]]


def fields(spark, pages, chain=GENERIC_CHAIN):
    return by_page(extract_fields(with_signals(parsed(spark, pages)), chain, JobConfig(), builtin_taxonomy(spark)), "fields")


def test_structured_data_rules(spark):
    product = {"@type": "Product", "name": "N", "image": "i.png"}
    pages = [
        ld({**product, "offers": {"price": 0}}, {**product, "offers": {"price": 5}}),
        ld({"@type": "Product", "name": "N", "offers": [{"price": "5"}, {"price": "1"}]}, {"@type": "Product", "image": {"url": "j.png"}, "mrp": 9}),
        ld({**product, "image": []}, "{bad", {**product, "image": 5}),
        ld({**product, "offers": {"price": -5}, "highPrice": "7"}),
        ld({**product, "offers": "x", "mrp": "", "listPrice": 0, "highPrice": [3]}),
        ld([{"a": [{"@type": ["x", "PRODUCT"], "name": " n ", "image": ""}]}]),
        ld({**product, "category": ["", "Home", "A", "N"]}),
    ]
    got = [(f.name, f.image_url, f.asp and float(f.asp), f.mrp and float(f.mrp), f.category) for f in fields(spark, pages)]
    base = "https://shop.example/details/"
    assert got == [
        ("N", base + "i.png", 0, None, None), ("N", base + "j.png", 5.0, 9.0, None), ("N", None, None, None, None),
        ("N", base + "i.png", -5.0, 7.0, None), ("N", base + "i.png", None, None, None), ("n", URL, None, None, None), ("N", base + "i.png", None, None, "A"),
    ]


def test_breadcrumbs(spark):
    items = [{"position": 2, "name": "Bags"}, {"position": 1, "item": {"name": "Women"}}, {"name": 5}, "x"]
    pages = [
        ld({"@type": "BreadcrumbList", "itemListElement": items}),
        ld({"@type": "BreadcrumbList", "itemListElement": {}}, {"@type": "BreadcrumbList", "itemListElement": [{"name": "A"}]}),
        '<nav aria-label="Breadcrumb"><a>Home</a><span>›</span><a>Women</a><a>Women</a><a>Bags</a></nav>',
        '<nav aria-label="Breadcrumb"><a>Home</a></nav><div id="x-breadcrumb"><a>A</a><a>B</a></div>',
        '<meta property="og:title" content="Kitty"><ol class="breadcrumbs"><li>Bags</li><li>KITTY</li></ol>',
    ]
    assert [(f.category, f.subcategory) for f in fields(spark, pages)] == [
        ("Women", "Bags"), ("A", None), ("Women", "Bags"), ("A", "B"), ("Bags", None)]


def test_embedded_detail(spark):
    key = '"/n/api/trade/intention/item/detail"'
    detail = {"goodsId": 1, "goodsName": "Brace } name", "images": [{"picThumb": "/a.jpg"}], "salesPrice": 100, "promotePrice": None,
              "level2CatId": 424242, "level3CatId": True}
    pages = [f"<script>{{{key}:{json.dumps(detail)}}}</script>", f"<script>{key}</script>", f'<script>{key}:{{"other":1}}</script>', f"<script>{key}:{{cut"]
    got = [(f.name, f.image_url, f.asp and int(f.asp), f.category, f.subcategory) for f in fields(spark, pages, SITE_CHAIN)]
    assert got == [("Brace } name", "https://shop.example/a.jpg", 100, "cat:424242", None)] + [(None, None, None, None, None)] * 3


def test_built_products_refuse_bad_values(spark):
    good = {"@type": "Product", "name": "N", "image": "/i.png", "offers": {"price": 5}}
    pages = [ld(good), ld({**good, "offers": {"price": -1}}), ld({**good, "image": "data:x"}), ld({**good, "name": ""})]
    rows = build_products(extract_fields(with_signals(parsed(spark, pages)), GENERIC_CHAIN, JobConfig()), keep=("page_id",))
    assert by_page(rows, "usable") == [True, False, False, False]


NEXT = {
    '<link rel="next" href="?page=2"><a href="/x">next</a>': "?page=2",
    '<a rel="next" href="/l?page=2#g">2</a>': "?page=2", '<a aria-label="Go to NEXT page" href="?page=2">x</a>': "?page=2",
    '<ul><li class="next"><a href="?page=2">more</a></li></ul>': "?page=2", '<a href="?page=2">Next →</a>': "?page=2",
    '<a href="?page=2"> › </a>': "?page=2", '<nav><a href="?page=1">1</a><a href="?page=2">2</a></nav>': "?page=2",
    '<div class="pager"><p><a href="?page=2">2</a></p></div>': "?page=2",
    '<div class="pagination"><b class="current">4 of 9</b><a href="?page=5">5</a></div>': "?page=5",
    '<a href="/d">next day delivery</a>': None, '<p><a href="?page=2">2</a></p>': None, '<div class="homepage"><a href="?page=3">3</a></div>': None,
    '<a rel="next" href="https://other.example/l?page=2">n</a>': None, '<a rel="next" href="">n</a>': None, "<p>next</p>": None,
}


def test_next_links(spark):
    got = by_page(with_next_link(parsed(spark, NEXT, "https://s.example/l")), "next_url")
    assert got == [None if n is None else f"https://s.example/l{n}" for n in NEXT.values()]


@pytest.mark.parametrize("html,want", [
    ("<button class='btn load-more'>x</button>", True), ("<a>See   more</a>", True), ("<button hidden data-load-more>x</button>", False),
    ("<button>Download more</button>", False), ("<p>show more</p>", False), ("<button class='js-load-more' disabled>x</button>", False),
])
def test_lazy_signal(spark, html, want):
    assert by_page(with_lazy_signal(parsed(spark, [html])), "lazy_load") == [want]


def test_json_without_numbers_of_its_own():
    from shelfspark.operators.parse import _json_ld_block
    assert _json_ld_block('{"@type":"Product","weight":NaN,"d":[Infinity,1.5]}')[2] == '{"@type": "Product", "weight": null, "d": [null, 1.5]}'


def test_misnested_tags(spark):
    """Expected parents: an end tag closes what stands inside its element, and stops at a stronger one."""
    cases = {
        "<b>1<i>2</b>3</i>4": {"b": None, "i": "b"},
        "<div><b><div>x</b>y</div><p>z</p></div><i>w</i>": {"b": "div", "p": "b", "i": None},  # the inner div holds, so b stays open
        "<table><tr><td><b>x</td><td></b>y</td></tr></table>": {"tr": "table", "td": "tr", "b": "td"},
        "<span><div></span><em>x</em></div><u>y</u></span>": {"div": "span", "em": "div", "u": "span"},
        "<ul><li>1<li>2<ul><li>3</ul></ul>": {"li": "ul"},
        "<table><tr><td>1<tr><td>2</table><s>x</s>": {"tr": "table", "td": "tr", "s": None},
        "<p>a<div>b</div></p><p>c": {"p": None, "div": None},
        "</b><q>x</q></div>": {"q": None},
    }
    rows = spark.createDataFrame([(h, h) for h in cases], "k string, html string")
    for r in parse_pages(rows).collect():
        for n in r.nodes:
            want = cases[r.k].get(n.tag, "any")
            got = r.nodes[n.parent].tag if n.parent >= 0 else None
            assert want == "any" or got == want, (r.k, n.tag, got)


def test_first_link_below_a_node(spark):
    html = '<div><p>a</p><ul><li><a>none</a><a href="/x">x</a></li><li>b</li></ul><a href="/y">y</a></div><i>c</i>'
    nodes = parse_pages(spark.createDataFrame([(html,)], "html string")).first().nodes
    below = {n.id: next((m.id for m in nodes if n.id < m.id <= n.last and m.tag == "a" and "href" in m.attrs), None) for n in nodes}
    assert {n.id: n.link for n in nodes} == below and below[0] is not None and below[len(nodes) - 1] is None


def test_robots_agree_with_the_standard_parser(spark):
    from urllib.robotparser import RobotFileParser
    from shelfspark.operators.robots import robots_gate, robots_rules
    agent = "Mozilla/5.0 (X11; Linux x86_64)"
    bodies = ["User-agent: *\nDisallow: *", "User-agent: *\nDisallow:\nDisallow: /a", "User-agent: *\nDisallow: /a*b\nAllow: /", "User-agent: *\nAllow: /p\nDisallow: /",
              "User-agent: mozilla\nDisallow: /a\n\nUser-agent: *\nDisallow: /", "", "Disallow: /", "User-agent: *\nDisallow: /a%2fb\nDisallow: /é",
              "User-agent: *\n" + "\n".join(f"Disallow: /d/{i}/" for i in range(0, 10_000, 2)) + "\nDisallow: /z"]
    paths = ["/", "/a", "/a/b", "/a%2Fb", "/a*b", "/p/1", "/*", "/%C3%A9", "/é?x", "/d/4998/x", "/d/4999/x", "/z?q=1", ""]
    robots = spark.createDataFrame([(f"https://h{i}.example", 200, b) for i, b in enumerate(bodies)], "origin string, status int, body string")
    urls = spark.createDataFrame([(f"https://h{i}.example{p}",) for i in range(len(bodies)) for p in paths], "url string")
    got = {r.url: r.allowed for r in robots_gate(urls, robots_rules(robots, agent)).collect()}
    for i, body in enumerate(bodies):
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        for p in paths:
            url = f"https://h{i}.example{p}"
            assert got[url] == parser.can_fetch(agent, url), (body[:60], p)
