"""Storefront inputs rendered from the given tables.

The tables hold no shop markup, so pages, feeds, sitemaps and robots files are
written out of ``part``, ``supplier`` and ``orders`` with SQL text functions.
Format, position, missing fields and decoys vary by key; the amount grows with
the tables.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.config import DETAIL_KEY
from shelfspark.operators.ranking import with_place
from shelfspark.session import stored

#: Tasks a given table is dealt out to: at least so many, and one for so many rows.
TASKS, TASK_ROWS = 16, 100_000
PER_PAGE = 20
SHARD = 100


_WRITTEN: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, dealt out: each is one row group, which no scan can split.

    A larger table is dealt to more tasks, so that a task's rows stay as many. They are dealt by the
    first column, its key: dealing in turn would sort all rows of the scan first.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(max(TASKS, -(-rows.count() // TASK_ROWS)), rows.columns[0])


def written(render):
    """Write a rendered input once per application and read it back as a table.

    Captures are tables in real life; a rendering left in the plan would be
    optimized, pushed into and compiled again with every query over it.
    """
    @wraps(render)
    def read(spark: SparkSession, sf_dir: str, *args: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, render.__name__, sf_dir, *args)
        if key not in _WRITTEN:
            _WRITTEN[key] = stored(render(spark, sf_dir, *args))
        return _WRITTEN[key]
    return read


def money_styles(df: DataFrame, cents: str, key: str, out: str) -> DataFrame:
    """A price text of an amount in cents; the key picks one of four styles."""
    whole, rest = f"({cents} div 100)", f"lpad(cast({cents} % 100 as string), 2, '0')"

    def grouped(sep: str) -> str:
        return (
            f"case when {whole} >= 1000 then concat({whole} div 1000, '{sep}', "
            f"lpad(cast({whole} % 1000 as string), 3, '0')) else cast({whole} as string) end"
        )
    us, eu = f"concat({grouped(',')}, '.', {rest})", f"concat({grouped('.')}, ',', {rest})"
    return df.withColumn(out, F.expr(f"""case {key} % 4
        when 0 then concat('₹', {us})
        when 1 then concat('Rs. ', {eu})
        when 2 then concat('MRP ', {whole}, '.', {rest})
        else concat('Sale price: ', {us}, ' only') end"""))


def goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: shop, addresses and prices in cents."""
    df = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as k", "p_name as name", "p_brand as brand", "p_type as kind", "p_size as size",
        "concat(lower(replace(p_brand, '#', '-')), '.shop.example') as host",
        "cast(round(p_retailprice * 100) as bigint) + 100000 * (p_partkey % 3) as mrp_c",
    )
    df = df.withColumn("asp_c", F.expr("case when k % 2 = 0 then mrp_c - 100 * size else mrp_c end"))
    df = df.withColumn("url", F.expr("concat('https://', host, '/details/', replace(name, ' ', '-'), '-', k)"))
    df = money_styles(df, "mrp_c", "k", "mrp_text")
    return money_styles(df, "asp_c", "(k + 1)", "asp_text")


def _page(head: str, body: str) -> str:
    return f"""concat('<!DOCTYPE html><html><head><meta charset="utf-8">', {head},
        '</head><body><header><a href="/cart">Cart</a></header>', {body}, '</body></html>')"""


#: Neighbours' cards: their prices are never the page's own.
RELATED = """'<ul class="related"><li><a href="/details/other-1">Other</a><span class="price">₹1.00</span></li>
    <li><div><a href="/details/other-2">More</a><b class="Price">$2</b></div></li></ul>'"""

JSON_LD = """concat('<script type="application/ld+json">{"@type": "Product", "name": broken</script>',
    '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"WebPage","name":"page"},',
    '{"@type":', if(k % 2 = 0, '"product"', '["Thing","Product"]'), ',"name":"  ', name, ' ","image":',
    case k % 3 when 0 then concat('"../img/', k, '.jpg"')
               when 1 then concat('["/img/', k, '.jpg","/img/second.jpg"]')
               else concat('{"@type":"ImageObject","url":"//', host, '/img/', k, '.jpg"}') end,
    if(k % 7 = 0, ',"weight":NaN,"depth":[-Infinity]', ''),
    ',"offers":', case k % 4
        when 0 then concat('{"@type":"Offer","price":"', asp_text, '"}')
        when 1 then concat('[{"price":', asp_c div 100, '.', lpad(cast(asp_c % 100 as string), 2, '0'), '},{"price":1}]')
        when 2 then concat('{"price":0,"priceSpecification":[{"price":"', asp_text, '"}]}')
        else concat('[{"priceSpecification":{"price":"', asp_text, '"}}]') end,
    case k % 5 when 0 then '' when 1 then concat(',"mrp":"', mrp_text, '"')
               when 2 then concat(',"mrp":0,"listPrice":"', mrp_text, '"')
               else concat(',"highPrice":"', mrp_text, '"') end,
    ',"category":', case k % 4
        when 0 then concat('"Home > ', kind, ' > ', brand, ' > ', name, '"')
        when 1 then concat('"', kind, '/', brand, '"')
        when 2 then concat('["shop"," ', kind, '","', brand, '"]')
        else concat('{"item":{"name":"', kind, '"}}') end,
    '}]}</script>')"""

MICRODATA_HEAD = """case k % 3 when 0 then concat('<meta property="og:image" content="/img/', k, '.jpg">') else '' end"""
MICRODATA = f"""concat('<div itemscope itemtype="https://schema.org/Product"><h1>Wrong ', k, '</h1>',
    if(k % 2 = 0, concat('<h2 itemprop="name"> ', name, '</h2>'), concat('<meta itemprop="name" content="', name, '">')),
    '<img src="/logo-big.png" width="2000" height="2000">',
    case k % 3 when 0 then '' when 1 then concat('<img itemprop="image" src="/img/', k, '.jpg">')
        else concat('<img src="/img/small.jpg" width="10" height="10"><img data-src="/img/', k,
                    '.jpg" width="600" height=" 400 "><img src="/img/late.jpg" width="400" height="600">') end,
    case when k % 4 = 0 then concat('<p><span itemprop="price" content="', asp_c div 100, '.',
                                    lpad(cast(asp_c % 100 as string), 2, '0'), '">now</span></p>')
         when k % 4 = 1 then concat('<b data-price="', asp_text, '">old</b>')
         else concat('<del class="was-PRICE">', mrp_text, '</del><b class="price now">', asp_text, '</b>') end,
    '</div>', {RELATED})"""

SELECTORS_HEAD = "''"
SELECTORS = """concat(
    case k % 3 when 0 then concat('<h1> <b></b></h1><h1> ', name, '</h1>')
               when 1 then concat('<div data-testid="product-name">', name, '</div>')
               else concat('<p class="x goodsName-1 y">', name, '</p>') end,
    if(k % 2 = 0, concat('<div class="box product-image"><span><img data-src="/img/', k, '.jpg"></span></div>'),
                  concat('<img data-main-image src="/img/', k, '.jpg">')),
    case k % 3 when 0 then concat('<del><i class="price">', mrp_text, '</i></del>')
               when 1 then concat('<b class="mrp">', mrp_text, '</b>')
               else concat('<span class="price--original">', mrp_text, '</span>') end,
    case k % 4 when 3 then '' when 0 then concat('<b data-asp>', asp_text, '</b>')
               when 1 then concat('<b class="a selling-price b">', asp_text, '</b>')
               else concat('<b class="price--sale">', asp_text, '</b>') end)"""

OG_HEAD = """concat('<title>', name, ' &amp; more</title>',
    case k % 3 when 0 then '' when 1 then concat('<meta property="og:title" content=" ', name, ' ">')
               else concat('<meta name="og:title" content="', name, '">') end,
    case k % 4 when 0 then '' else concat('<meta property="og:image" content="../img/', k, '.jpg">') end)"""

DETAIL_JSON = """concat('{"goodsId":', k, ',"note":"brace } and \\\\" quote",',
    if(k % 6 = 0, concat('"goodsName":"","shortGoodsName":"', name, '"'), concat('"goodsName":" ', name, '"')),
    ',"images":', if(k % 3 = 0, '[]', concat('[7,{"picThumb":"","picUrl":"/img/', k, '.jpg"}]')),
    ',"goodsThumb":"/img/', k, '.jpg"',
    ',"salesPrice":', if(k % 2 = 0, concat('"', mrp_text, '"'), concat(mrp_c div 100, '.', lpad(cast(mrp_c % 100 as string), 2, '0'))),
    ',"promotePrice":', case when k % 2 = 0 then concat('"', asp_text, '"') when k % 4 = 1 then 'null' else '99999' end,
    ',"level2CatId":', case k % 5 when 0 then '11' when 1 then '"12"' when 2 then cast(9000 + size as string) when 3 then 'true' else '750' end,
    ',"level3CatId":', case k % 3 when 0 then '57' when 1 then '79' else 'null' end, '}')"""
EMBEDDED = f"""concat('<script>window.cache={{{DETAIL_KEY}:', {DETAIL_JSON}, '}};</script>')"""

MARKUP = {
    "jsonld": (JSON_LD, "concat('<h1>', name, '</h1>')"),
    "microdata": (MICRODATA_HEAD, MICRODATA),
    "selectors": (SELECTORS_HEAD, SELECTORS),
    "og": (OG_HEAD, "'<p>text</p>'"),
    "embedded": ("''", EMBEDDED),
}


@written
def product_pages(spark: SparkSession, sf_dir: str, markup: str) -> DataFrame:
    """``(page_id, url, html)``: every part as a product page in one markup."""
    head, body = MARKUP[markup]
    return goods(spark, sf_dir).selectExpr("k as page_id", "url", f"{_page(head, body)} as html")


@written
def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields split over markups by key, so that a merge has gaps to fill."""
    head = f"concat(if(k % 5 in (0, 1), {JSON_LD}, ''), if(k % 5 in (1, 2), {OG_HEAD}, ''))"
    body = (
        f"concat(if(k % 5 in (2, 3), {MICRODATA}, ''), if(k % 5 = 4, {SELECTORS}, ''), if(k % 5 = 3, {EMBEDDED}, ''))"
    )
    return goods(spark, sf_dir).selectExpr("k as page_id", "url", f"{_page(head, body)} as html")


@written
def breadcrumb_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails as list markup, category path or navigation, of varying depth."""
    lists = """concat('<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[',
        '{"position":3,"name":"', brand, '"},{"position":1,"name":"', if(k % 2 = 0, 'Home', 'SHOP'), '"},',
        '"stray",{"position":2,"item":{"name":" ', kind, '"}}', if(k % 5 = 0, '', concat(',{"position":9,"name":"', name, '"}')),
        ']}</script>')"""
    path = """concat('<script type="application/ld+json">{"@type":"Product","category":"All › ', kind,
        if(k % 2 = 0, concat(' › ', brand), ''), ' › ', name, '"}</script>')"""
    nav = """concat(case k % 3 when 0 then '<nav aria-label="Your Breadcrumbs"><ul>' when 1 then '<ol class="x BreadCrumb-list">'
            else '<div id="main-breadcrumb">' end,
        '<li><a href="/">Home</a></li><li> / </li><li><a href="/t">', kind, '</a> </li>',
        '<li><meta itemprop="name" content="', brand, '"></li><li>', name, '</li>',
        case k % 3 when 0 then '</ul></nav>' when 1 then '</ol>' else '</div>' end)"""
    single = """'<p class="breadcrumb"><a href="/">Home</a></p>'"""
    head = f"concat('<title>t</title>', case k % 4 when 0 then {lists} when 1 then {path} else '' end)"
    title = "if(k % 8 = 5, concat('<meta property=\"og:title\" content=\"', upper(name), '\">'), concat('<h1>', replace(name, ' ', '  '), '</h1>'))"
    body = f"concat({title}, case k % 4 when 2 then {nav} when 3 then {single} else '' end)"
    return goods(spark, sf_dir).selectExpr("k as page_id", "url", f"{_page(head, body)} as html")


@written
def signal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages, grids of varying size and pages with explicit markup."""
    card = """'<article><h3>a</h3><div><a href="/details/n">n</a><p class="price_color">£5</p></div></article>'"""
    body = f"""case k % 6
        when 0 then concat('<section><p class="price">', mrp_text, '</p></section>')
        when 1 then concat('<div><b itemprop="price">', mrp_text, '</b></div>', {RELATED})
        when 2 then repeat({card}, 1 + size % 5)
        when 3 then '<p>no offer here</p>'
        when 4 then concat('<div itemtype="http://SCHEMA.org/product"></div>', repeat({card}, size % 3))
        else concat('<div><a href="/x">x</a><p>', repeat('many words ', 40), '</p><i class="PRICE">', mrp_text, '</i></div>') end"""
    return goods(spark, sf_dir).selectExpr("k as page_id", "url", f"{_page(chr(39) * 2, body)} as html")


# --------------------------------------------------------------------------
# A shop per brand: listing pages, product pages, sitemaps
# --------------------------------------------------------------------------
@written
def numbered_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goods with their place in their brand's listing (``i``) and its size (``n``)."""
    return with_place(goods(spark, sf_dir), ["brand"], "k", 10_000, "i", "n")


@written
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of 20 products per brand with pagination, decoys and overlap.

    The brand number picks the pagination markup: rel=next, label or number.
    Every grid links 30 activity pages, more than it has products.
    """
    g = numbered_goods(spark, sf_dir).withColumn("p", F.expr(f"i div {PER_PAGE}"))
    card = """concat('<li><a href="', case when k % 3 = 0 then url when k % 3 = 1 then concat(url, '?src=grid')
        else concat('/details/', replace(name, ' ', '-'), '-', k) end, '">', name, '</a><span class="price">', asp_text, '</span></li>')"""
    pages = g.withColumn("card", F.expr(card)).groupBy("brand", "host", "p", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda c: c["card"]), "").alias("cards")
    )
    pages = pages.withColumn("b", F.expr("cast(substring(brand, 7) as int)")).withColumn(
        "last", F.expr(f"(n - 1) div {PER_PAGE}")
    )
    decoys = """concat('<nav>', array_join(transform(sequence(1, 30), j -> concat('<a href="/activity/', j, '">', 'Deal</a>')), ''),
        '<a href="/cart">cart</a><a href="/details/checkout">pay</a><a href="https://other.example/details/z-1">ad</a>',
        '<a href="mailto:a@b.example">mail</a></nav>')"""
    pager = """case when p >= last then '<a href="#top">delivery next day</a>' else
        case b % 3 when 0 then concat('<a rel="next" href="/collections/all?page=', p + 2, '#grid">more</a>')
                   when 1 then concat('<a href="?page=', p + 2, '"> Next Page </a>')
                   else concat('<div class="pagination"><a href="?page=', p + 3, '">', p + 3, '</a><a href="/collections/all?page=', p + 2, '">', p + 2, '</a></div>') end end"""
    return pages.selectExpr(
        "cast(-1 - (b * 1000000 + p) as bigint) as page_id",
        "concat('https://', host, '/collections/all', if(p = 0, '', concat('?page=', p + 1))) as url",
        f"concat('<html><body>', {decoys}, '<ul>', cards, '</ul>', {pager}, '</body></html>') as html",
    )


@written
def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures of the brand shops: grids and JSON-LD product pages.

    Every 50th product page was not captured.
    """
    details = product_pages(spark, sf_dir, "jsonld").where("page_id % 50 <> 7")
    return listing_pages(spark, sf_dir).unionByName(details)


@written
def shop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per brand shop."""
    hosts = goods(spark, sf_dir).select("brand", "host").distinct()
    return hosts.selectExpr("brand as run_id", "concat('https://', host, '/collections/all') as seed_url")


def _gzipped(df: DataFrame) -> DataFrame:
    """Bodies as bytes; those of ``.gz`` addresses compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, texts = batch.column("url").to_pylist(), batch.column("text").to_pylist()
            bodies = [
                gzip.compress(t.encode()) if u.endswith(".gz") else t.encode() for u, t in zip(urls, texts)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("url"), batch.column("status"), pa.array(bodies, pa.binary())],
                names=["url", "status", "body"],
            )
    return df.select("url", "status", "text").mapInArrow(run, "url string, status int, body binary")


@written
def shop_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, status, body)``: index, product index, gzipped shards of 100 URLs.

    By brand number: a third of the shops declare the tree in robots.txt, a
    third have it at the default address, a third publish one flat sitemap.
    """
    g = numbered_goods(spark, sf_dir).withColumn("b", F.expr("cast(substring(brand, 7) as int)"))
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    shards = g.withColumn("s", F.expr(f"i div {SHARD}")).groupBy("host", "b", "s").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "url"))),
                                 lambda c: F.concat(F.lit("<url><loc> "), c["url"], F.lit("</loc></url>"))), "").alias("locs")
    )
    shard_docs = shards.where("b % 3 <> 2").selectExpr(
        "concat('https://', host, '/sm/products-', s, '.xml.gz') as url", "200 as status",
        f"concat('<?xml version=\"1.0\"?><urlset {ns}>', locs, if(s % 3 = 1, '<url><loc>https://x.example/y</lok></url>', ''), "
        "'<url><loc>https://stray.example/details/x?a=1&b=2</loc></url></urlset>') as text",
    )
    flat = shards.where("b % 3 = 2").groupBy("host").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("s", "locs"))), lambda c: c["locs"]), "").alias("locs")).selectExpr(
        "concat('https://', host, '/sitemap.xml') as url", "200 as status",
        f"concat('<urlset {ns}>', locs, '</urlset>') as text",
    )
    tops = g.where("b % 3 <> 2").groupBy("host", "b").agg(F.expr(f"(max(i) div {SHARD}) + 1").alias("m"))
    index = tops.selectExpr(
        "concat('https://', host, if(b % 3 = 0, '/maps/index.xml', '/sitemap.xml')) as url", "200 as status",
        f"""concat('<sitemapindex {ns}><sitemap><loc>https://', host, '/sm/categories.xml</loc></sitemap>',
            '<sitemap><loc>https://', host, '/sm/products-index.xml</loc></sitemap>',
            '<sitemap><loc>https://', host, '/sm/products-gone.xml</loc></sitemap></sitemapindex>') as text""",
    )
    product_index = tops.selectExpr(
        "concat('https://', host, '/sm/products-index.xml') as url", "200 as status",
        f"""concat('<s:sitemapindex xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9">', array_join(transform(sequence(0, m - 1),
            j -> concat('<s:sitemap><s:loc>https://', host, '/sm/products-', j, '.xml.gz</s:loc></s:sitemap>')), ''), '</s:sitemapindex>') as text""",
    )
    gone = tops.selectExpr("concat('https://', host, '/sm/products-gone.xml') as url", "404 as status", "'gone' as text")
    other = tops.selectExpr(
        "concat('https://', host, '/sm/categories.xml') as url", "200 as status",
        f"concat('<urlset {ns}><url><loc>https://', host, '/collections/all</loc></url></urlset>') as text",
    )
    return _gzipped(shard_docs.union(flat).union(index).union(product_index).union(gone).union(other))


@written
def shop_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots files of the brand shops, captured twice; only some name a sitemap."""
    good = goods(spark, sf_dir).select("brand", "host").distinct().selectExpr(
        "concat('https://', host) as origin", "200 as status",
        """concat('User-agent: *\\nDisallow: /cart\\n', if(cast(substring(brand, 7) as int) % 3 = 0,
            concat('SiteMap:  https://', host, '/maps/index.xml\\n'), 'Sitemap:\\n')) as body""",
    )
    return good.unionByName(good.selectExpr("origin", "503 as status", "'Sitemap: https://busy.example/x.xml' as body"))


# --------------------------------------------------------------------------
# Listing feed
# --------------------------------------------------------------------------
def feed_record(promote: bool = True) -> str:
    """A goods record; ids, prices and images come in several JSON types."""
    return """concat('{"goodsId":', if(k % 40 = 13, concat('"', k, '"'), cast(k as string)), ',"goodsName":"', if(k % 40 = 14, ' ', name), '"',
        ',"salePrice":', if(k % 2 = 0, concat('"', mrp_text, '"'), concat(mrp_c div 100, '.', lpad(cast(mrp_c % 100 as string), 2, '0'))),
        ',"promotePrice":', case k % 3 when 0 then concat('"', asp_text, '"') when 1 then 'null' else '99999.5' end,
        ',"imageList":', case k % 4 when 0 then concat('[{"goodsThumb":"https://', host, '/img/a.jpg"},{"select":true,"goodsThumb":"https://', host, '/img/', k, '.jpg"}]')
            when 1 then concat('[{"select":true},{"skcMainImg":"https://', host, '/img/', k, '.jpg"}]')
            when 2 then concat('[5,{"colorPic":"https://', host, '/img/', k, '.jpg"}]') else
            if(k % 40 = 15, '[]', concat('[{"goodsThumb":"","skcMainImg":"","colorPic":"https://', host, '/img/', k, '.jpg"}]')) end, '}')"""


@written
def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(flow_id, page_index, status, body)``: a listing per brand and per type.

    Listings overlap.  By brand number: an error envelope as third page, a page
    repeated behind the last one, or an HTTP error behind the last one.
    """
    g = goods(spark, sf_dir).withColumn("record", F.expr(feed_record()))
    b = "cast(substring(brand, 7) as int)"
    by_brand = g.withColumn("flow", F.expr(f"{b} + 100"))
    kinds = "case kind when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 when 'PROMO' then 4 when 'SMALL' then 5 else 6 end"
    by_kind = g.withColumn("flow", F.expr(f"200 + {kinds}"))
    both = by_brand.unionByName(by_kind)
    both = with_place(both, ["flow"], "k", 10_000, "i", "n")
    pages = both.groupBy("flow", "n", F.expr(f"cast(i div {PER_PAGE} + 1 as int)").alias("page_index")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "record"))), lambda c: c["record"]), ",").alias("records")
    ).withColumn("last", F.expr(f"cast((n - 1) div {PER_PAGE} + 1 as int)"))
    tail = "(flow < 200 and flow % 5 in (0, 2))"
    normal = pages.selectExpr(
        "cast(flow as string) as flow_id", "page_index", "200 as status",
        f"""if(flow < 200 and flow % 5 = 1 and page_index = 3, '{{"ret":500,"msg":"busy"}}',
            concat('{{"ret":200,"data":{{"goodsList":[', records, '],"hasNextPage":', if(page_index < last or {tail}, 'true', 'false'), '}}}}')) as body""",
    )
    behind = pages.where(f"page_index = last and {tail}").selectExpr(
        "cast(flow as string) as flow_id", "page_index + 1 as page_index",
        "if(flow % 5 = 0, 200, 503) as status",
        """if(flow % 5 = 0, concat('{"ret":200,"data":{"goodsList":[', records, '],"hasNextPage":true}}'), 'oops') as body""",
    )
    return normal.unionByName(behind)


@written
def feed_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home page that links every listing, as ``(run_id, seed_url, html)``."""
    brands = table(spark, sf_dir, "part").selectExpr("cast(substring(p_brand, 7) as int) + 100 as flow").distinct()
    kinds = table(spark, sf_dir, "part").selectExpr(
        "200 + case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3 when 'PROMO' then 4 when 'SMALL' then 5 else 6 end as flow"
    ).distinct()
    links = brands.union(kinds).groupBy().agg(F.array_sort(F.collect_list("flow")).alias("flows"))
    return links.selectExpr(
        "'site' as run_id", "'https://shop.example/activity/103?from=home' as seed_url",
        """concat('<html><body>', array_join(transform(flows, f -> concat('<a href="/activity/', f, '">x</a><i data-u="/activity/', f, '/top"></i>')), ''), '</body></html>') as html""",
    )


@written
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail pages of the feed's products; some are missing, broken or errors."""
    g = goods(spark, sf_dir).where("k % 10 <> 3")
    html = f"if(k % 10 = 4, '<html>nothing</html>', concat('<html><body>', {EMBEDDED}, '</body></html>'))"
    return g.selectExpr(
        "k as page_id", "if(k % 10 = 5, 500, 200) as status",
        "concat('shop.example/details/', replace(name, ' ', '-'), '-', k) as product_key", f"{html} as html",
    )


# --------------------------------------------------------------------------
# Robots by supplier, run requests by order, product rows by line item
# --------------------------------------------------------------------------
@written
def supplier_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots files of supplier hosts in six forms, one of them absent; answered ones have a failed capture too."""
    files = table(spark, sf_dir, "supplier").where("s_suppkey % 6 <> 0").selectExpr(
        "concat('https://supplier-', s_suppkey, '.example') as origin",
        "if(s_suppkey % 6 = 1, 404, 200) as status",
        """case s_suppkey % 6 when 2 then '# closed\\nUser-agent: *\\nDisallow: /'
            when 3 then 'User-agent: *\\nDisallow: *\\nAllow: /details/10\\nDisallow: /details/1'
            when 4 then 'User-agent: *\\nDisallow: /\\n\\nUser-Agent: Mozilla\\nDisallow: /details/2\\nDisallow:'
            when 5 then 'User-agent: otherbot\\nDisallow: /\\n\\nUser-agent: *\\nDisallow: /details/3%35'
            else 'User-agent: *\\nDisallow: /' end as body""",
    )
    return files.unionByName(files.where("status = 200").selectExpr("origin", "500 as status", "'User-agent: *\\nDisallow: /' as body"))


def suppliers(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").count()


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as run requests on supplier hosts; a fifth names no cap, some caps are out of bounds."""
    n = suppliers(spark, sf_dir)
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as run_id",
        f"""case when o_orderkey % 17 = 0 then concat('ftp://supplier-', o_custkey % {n}, '.example/details/1')
             else concat(' https://supplier-', o_custkey % {n}, '.example/details/', o_orderkey % 40, ' ') end as url""",
        "cast(if(o_orderkey % 5 > 0, o_custkey * 7 - 100, null) as int) as max_products",
        "o_orderpriority = '1-URGENT' as ignore_robots",
        "o_orderdate as created_at",
    )


def line_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as extracted products: runs by return flag, repeats by part."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_returnflag, l_linestatus) as run_id",
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as discovery_ord",
        "l_orderkey", "l_linenumber", "l_partkey",
        "if(l_tax = 0.08 and l_discount = 0.1, '  ', concat('part ', l_partkey)) as name",
        "cast(null as string) as category", "cast(null as string) as subcategory",
        "concat('https://img.example/', l_partkey, '.jpg') as image_url",
        "cast(if(l_discount = 0.05, null, l_extendedprice) as decimal(28,10)) as mrp",
        "cast(if(l_discount = 0.05, null, if(l_tax = 0.04, 0, if(l_tax = 0.07, l_extendedprice + 1, l_extendedprice))) as decimal(28,10)) as asp",
        "concat('https://parts.example/details/', l_partkey, if(l_linenumber % 2 = 0, '/?v=1', '')) as product_url",
        "concat('parts.example/details/', l_partkey) as product_key",
        "l_quantity <> 13 as usable",
    )


#: Inputs that are written once, with their arguments.
INPUTS = (
    (numbered_goods,), (listing_pages,), (mixed_pages,), (breadcrumb_pages,), (signal_pages,), (shop_pages,), (shop_runs,), (shop_sitemaps,), (shop_robots,), (feed_pages,), (feed_seed,), (detail_pages,), (supplier_robots,),
    *((product_pages, kind) for kind in ("jsonld", "microdata", "embedded")),
)
