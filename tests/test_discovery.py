"""Clusters, walks, sitemaps, robots and routing against brute force."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import clusters as C
from shelfspark.operators import pagination as P
from shelfspark.operators import sitemaps as M
from shelfspark.operators.robots import robots_gate, robots_rules
from shelfspark.operators.routing import route

HOST = "https://s.example"


def test_clusters_rank_by_size_then_first_url(spark):
    urls = [f"{HOST}/activity/{i}" for i in range(7)] + [f"{HOST}/details/p-{i}" for i in range(4)]
    urls += [f"{HOST}/catalogue/b{i}/index.html" for i in range(4)] + [f"{HOST}/{s}" for s in ("a", "b", "cart", "c")] + [f"{HOST}/x/1", f"{HOST}/seed/"]
    df = spark.createDataFrame([("r", f"{HOST}/seed", u) for u in urls], "run_id string, seed_url string, url string")
    got = C.candidate_clusters(C.shaped_links(df)).orderBy("rank").collect()
    assert [(r.template, r.n_urls) for r in got] == [
        ("/activity/*", 7), ("/catalogue/*/index.html", 4), ("/details/*", 4), ("/*", 3)]


def test_first_verified_cluster_wins(spark):
    rows = [("r", 1, "/a/*", False), ("r", 2, "/b/*", True), ("r", 3, "/c/*", True), ("q", 1, "/d/*", False), ("q", 2, "/e/*", False)]
    got = C.decide_patterns(spark.createDataFrame(rows, "run_id string, rank int, template string, verified boolean"))
    assert {r.run_id: (r.template, r.warning) for r in got.collect()} == {
        "r": ("/b/*", None), "q": (None, "Tried the 2 largest shapes of links (/d/*, /e/*); their samples held no products.")}


@pytest.mark.parametrize("cap", [0, 1, 2, 5, 50])
def test_walk_agrees_with_following_links(spark, cap):
    rng = random.Random(7)
    n = 60
    nxt = {i: i + 1 for i in range(20)} | {i: rng.randrange(n) for i in range(21, n)} | {20: 3}
    url = lambda i: f"{HOST}/l?page={i}"
    edges = spark.createDataFrame([(url(a), url(b)) for a, b in nxt.items() if a != b], "page_key string, next_key string")
    seeds = {f"r{i}": i for i in range(0, n, 3)} | {"hot1": 0, "hot2": 0, "gone": 999}
    runs = spark.createDataFrame([(r, url(i) + "#x") for r, i in seeds.items()], "run_id string, seed_url string")
    got = {(r.run_id, r.page_key, r.page_pos) for r in P.walk_pages(runs, edges, cap).collect()}
    want = set()
    for run, at in seeds.items():
        seen = []
        while at is not None and at not in seen and (not cap or len(seen) < cap):
            seen.append(at)
            at = nxt.get(at)
        want |= {(run, url(a), i) for i, a in enumerate(seen)}
    assert got == want


def _index(*urls):
    return ("<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>").encode()


def _urlset(*urls):
    return ("<urlset>" + "".join(f"<url><loc>\n {u} </loc></url>" for u in urls) + "</urlset>").encode()


def sitemap_urls(spark, docs, robots="", max_docs=40, max_urls=50_000):
    rows = [(u, 200, bytearray(b)) for u, b in docs.items()]
    parsed = M.parse_sitemaps(spark.createDataFrame(rows, "url string, status int, body binary"))
    runs = spark.createDataFrame([("r", f"{HOST}/home")], "run_id string, seed_url string")
    files = spark.createDataFrame([(HOST, 200, robots)], "origin string, status int, body string")
    visited = M.walk_sitemaps(M.sitemap_roots(runs, files), parsed, max_docs)
    urls = M.sitemap_product_urls(visited, parsed, runs, max_urls)
    return [r.url for r in urls.orderBy("rank", "pos").collect()], visited.count()


def test_sitemap_tree(spark):
    docs = {
        f"{HOST}/sitemap.xml": _index(f"{HOST}/pages.xml", f"{HOST}/products.xml"),
        f"{HOST}/products.xml": _index(f"{HOST}/products-1.xml.gz", f"{HOST}/products-2.xml", f"{HOST}/products.xml"),
        f"{HOST}/products-1.xml.gz": gzip.compress(_urlset(f"{HOST}/p/1", "https://www.s.example/p/9", f"{HOST}/p/2&a=1")),
        f"{HOST}/products-2.xml": _urlset(f"{HOST}/p/2", f"{HOST}/p/1"),
        f"{HOST}/pages.xml": _urlset(f"{HOST}/about"),
    }
    assert sitemap_urls(spark, docs) == ([f"{HOST}/p/1", f"{HOST}/p/2&a=1", f"{HOST}/p/2"], 4)
    assert sitemap_urls(spark, docs, max_docs=3)[0] == [f"{HOST}/p/1", f"{HOST}/p/2&a=1"]
    assert sitemap_urls(spark, docs, max_urls=1)[0] == [f"{HOST}/p/1"]


def test_sitemap_edge_cases(spark):
    assert sitemap_urls(spark, {f"{HOST}/sitemap.xml": _urlset(f"{HOST}/p/1")})[0] == []
    assert sitemap_urls(spark, {f"{HOST}/sitemap.xml": b"<html><p>not xml"})[0] == []
    # declared product list is a root, and roots stand outside the product branch
    declared = {f"{HOST}/products.xml": _urlset(f"{HOST}/p/1")}
    assert sitemap_urls(spark, declared, robots=f"Sitemap: {HOST}/products.xml")[0] == []
    inflated = {f"{HOST}/sitemap.xml": _index(f"{HOST}/products.xml.gz"), f"{HOST}/products.xml.gz": _urlset(f"{HOST}/p/1")}
    assert sitemap_urls(spark, inflated)[0] == []


def test_robots(spark):
    files = [(HOST, 200, "User-agent: *\nDisallow: /private\nAllow: /private/ok\n"), ("https://t.example", 503, "Disallow: /")]
    rules = robots_rules(spark.createDataFrame(files, "origin string, status int, body string"), "Mozilla/5.0")
    urls = [f"{HOST}/private/ok", f"{HOST}/pub", f"{HOST}/%70rivate", "https://t.example/x", "https://u.example/x", "ftp://s.example/x", "x"]
    got = robots_gate(spark.createDataFrame([(u,) for u in urls], "url string"), rules)
    assert [(r.url, r.allowed) for r in got.collect()].sort() == list(zip(urls, [False, True, False, True, True, False, False])).sort()
    assert {r.url: r.allowed for r in got.collect()} == dict(zip(urls, [False, True, False, True, True, False, False]))


def test_routing(spark):
    adapters = spark.createDataFrame([("shop.example", "api"), ("de.shop.example", "sitemap")], "domain string, source string")
    hosts = ["www.shop.example", "shop.example", "x.de.shop.example", "notshop.example", "shop.example.org"]
    got = route(spark.createDataFrame([(f"https://{h}/x",) for h in hosts], "url string"), adapters)
    assert {r.url.split("/")[2]: r.source for r in got.collect()} == dict(zip(hosts, ["api", "api", "sitemap", "generic", "generic"]))


def test_locations_survive_broken_xml(spark):
    body = b"<?xml version='1.0'?><x:urlset xmlns:x='u'><x:url><x:loc>https://s.example/a?x=1&y=2</x:loc></x:url><url><loc>lost</lok></url>" \
           b"<!-- <loc>no</loc> --><url><loc> <![CDATA[https://s.example/b]]> </loc></url><sitemap><loc>https://s.example/n.xml</loc></sitemap><url><loc>https://s.example/c</loc></url>"
    docs = spark.createDataFrame([("https://s.example/m.xml", 200, body)], "url string, status int, body binary")
    got = M.parse_sitemaps(docs).collect()[0]
    assert got.pages == ["https://s.example/a?x=1&y=2", "https://s.example/b", "https://s.example/c"]
    assert got.nested == ["https://s.example/n.xml"]


def test_one_robots_row_per_origin(spark):
    files = spark.createDataFrame(
        [("https://s.example", 500, "x"), ("https://s.example", 200, "User-agent: *\nDisallow: /a"), ("https://s.example", 200, "User-agent: *\nDisallow: /z")],
        "origin string, status int, body string")
    urls = spark.createDataFrame([("https://s.example/a/1",)], "url string")
    from shelfspark.operators.robots import robots_gate, robots_rules
    assert [r.allowed for r in robots_gate(urls, robots_rules(files, "bot")).collect()] == [False]


def test_documents_in_pieces_and_chunks(monkeypatch):
    import gzip
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    nested = [f"https://s.example/n{i}.xml?a=1&amp;b=é" for i in range(7)]
    pages = [f"https://s.example/p/{i}?x=1&y={i}" for i in range(40)]
    text = (f'\n <?xml version="1.0"?><urlset {ns}>' + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in nested)
            + "<!-- <loc>https://no.example/</loc> -->" + "".join(f"<url><loc> {p} </loc><lastmod>1</lastmod></url>" for p in pages))
    whole, broken = (text + "</urlset>").encode(), (text + "<url><loc>https://cut.example/</url>").encode()
    want = ([n.replace("&amp;", "&") for n in nested], pages)
    for piece, chunk in ((1000, 1 << 20), (9, 16), (47, 5), (1, 100)):
        monkeypatch.setattr(M, "PIECE", piece)
        monkeypatch.setattr(M, "CHUNK", chunk)
        two = gzip.compress(whole[:300]) + gzip.compress(whole[300:]) + b"\0\0"
        for url, body in (("https://s.example/a.xml", whole), ("https://s.example/a.xml", gzip.compress(whole)), ("https://s.example/a.xml.gz", two), ("https://s.example/b.xml", broken)):
            found = list(M._pieces(url, body))
            assert ([x for f in found for x in f[2]], [x for f in found for x in f[3]]) == want
            at = [0, 0]
            for f in found:
                assert [f[0], f[1]] == at and 0 < len(f[2]) + len(f[3]) <= piece
                at = [at[0] + len(f[2]), at[1] + len(f[3])]
        for url, body in (("https://s.example/a.gz", whole), ("u", gzip.compress(whole)[:-20]), ("u", gzip.compress(b"<a></b>" + whole)[:-20]), ("u", b""), ("u", None), ("u", gzip.compress(whole) + b"rest")):
            assert list(M._pieces(url, body)) == [(0, 0, [], [])]


def test_a_large_document_needs_little_memory():
    import gzip
    import io
    import tracemalloc
    out = io.BytesIO()
    with gzip.open(out, "wb", 1) as f:
        f.write(b"<urlset>")
        for i in range(30):
            f.write(b"".join(b"<url><loc>https://s.example/some/long/path/of/a/product/%d/%d</loc><note>%s</note></url>" % (i, j, b"x" * 100) for j in range(10_000)))
        f.write(b"</urlset>")
    tracemalloc.start()
    n = sum(len(pages) for _, _, _, pages in M._pieces("u", out.getvalue()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000
    assert peak < 40 << 20  # the document inflates to 54 MB, its locations to 35 MB


def test_walk_order_does_not_depend_on_slices(spark, monkeypatch):
    import random
    draw = random.Random(4)
    def doc(urls):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
    tree = {"https://s.example/sitemap.xml": [f"https://s.example/m{i}.xml" for i in range(60)]}
    for i in range(60):
        tree[f"https://s.example/m{i}.xml"] = [f"https://s.example/{'product-' if i % 3 == 0 and j % 2 else ''}m{i}-{j}.xml" for j in range(draw.randint(0, 9))]
    docs = spark.createDataFrame([(u, 200, doc(c).encode()) for u, c in tree.items()], "url string, status int, body binary")
    runs = spark.createDataFrame([("r", "https://s.example/")], "run_id string, seed_url string")
    robots = spark.createDataFrame([], "origin string, status int, body string")
    want, queue = [], ["https://s.example/sitemap.xml"]
    while queue:
        url = queue.pop(0)
        want.append(url)
        children = tree.get(url, [])
        queue += [c for c in children if "product" in c] or children
    for piece, slice_ in ((50_000, 10_000), (50_000, 7)):
        monkeypatch.setattr(M, "SLICE", slice_)
        walked = M.walk_sitemaps(M.sitemap_roots(runs, robots), M.parse_sitemaps(docs)).collect()
        assert [r.url for r in sorted(walked, key=lambda r: r["rank"])] == want


def test_a_page_without_a_number_costs_no_failed_cast(spark, monkeypatch):
    """Fails where a text that was not found is cast: every such cast raises and catches."""
    from pyspark.sql import Column
    from pyspark.sql import functions as F

    from shelfspark.operators import pagination
    from shelfspark.operators.parse import parse_pages

    monkeypatch.setattr(Column, "try_cast", Column.cast)  # an error is an error now
    rows = [(1, "https://a.example/x", "<a href='/y'>y</a>"), (2, "https://a.example/x?page=4", "<p>"), (3, "https://a.example/page-7", None),
            (4, "https://a.example/x", "<a aria-current='page'> 12 </a>"), (5, None, "<a aria-current='page'>here</a>")]
    parsed = parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = parsed.select("page_id", pagination._current_page(F.col("url")).alias("n")).orderBy("page_id").collect()
    assert [r["n"] for r in got] == [1, 4, 7, 12, 1]
