"""Queries of the column library."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.money import money_text, parse_price
from shelfspark.functions.text import category_pair, run_id, slug, split_category_path
from shelfspark.functions.urls import (
    canonical_url,
    detail_url,
    domains_of,
    host_of,
    matches_template,
    product_key,
    resolve_url,
)
from shelfspark.operators.routing import route
from shelfspark.queries.registry import GOODS, money, query
from shelfspark.rendering.storefront import goods, order_requests, table

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query("price_formats", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(CASE l_linenumber % 7
    WHEN 3 THEN ({_CENTS} // 100)
    WHEN 5 THEN NULL
    ELSE {_CENTS} / 100.0 END AS DOUBLE) AS price
FROM lineitem""")
def price_formats(spark, sf_dir):
    """F2 over every line item's price in seven notations."""
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "cast(round(l_extendedprice * 100) as bigint) as c"
    ).withColumn("w", F.expr("c div 100")).withColumn("r", F.expr("lpad(cast(c % 100 as string), 2, '0')"))
    us = "case when w >= 1000 then concat(w div 1000, ',', lpad(cast(w % 1000 as string), 3, '0')) else cast(w as string) end"
    text = F.expr(f"""case l_linenumber % 7
        when 0 then concat('₹', {us}, '.', r)
        when 1 then concat('Rs. ', replace({us}, ',', '.'), ',', r, ' only')
        when 2 then concat('MRP', char(160), w, '.', r)
        when 3 then {us}
        when 4 then concat(w, ',', r)
        when 5 then element_at(array('free', 'N/A', '---', '', '1.2.3'), cast(c % 5 + 1 as int))
        else concat('Sale ', w, ' . ', r, ' - 5% off') end""")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", money(parse_price(text)).alias("price"))


@query("money_texts", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_tax = 0 THEN '' ELSE CAST(q // 100 AS VARCHAR) || '.' || lpad(CAST(q % 100 AS VARCHAR), 2, '0') END AS money
FROM (SELECT *, v // 100 + CASE WHEN v % 100 > 50 OR (v % 100 = 50 AND (v // 100) % 2 = 1) THEN 1 ELSE 0 END AS q
      FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS v FROM lineitem))""")
def money_texts(spark, sf_dir):
    """two decimals, half-even, of discounted prices with four."""
    exact = F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        money_text(F.when(F.col("l_tax") != 0, exact).cast("decimal(28,10)")).alias("money"),
    )


@query("slugs_and_urls", """
SELECT p_partkey, slug,
  CASE WHEN slug = '' THEN 'https://shop.example/details/' || p_partkey
       ELSE 'https://shop.example/details/' || slug || '-' || p_partkey END AS url
FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE
        replace(p_name, ' ', '-') || '-' || lower(p_type) || '-' || p_size END AS slug FROM part)""")
def slugs_and_urls(spark, sf_dir):
    """F10 and F12 on decorated part names."""
    name = F.expr("if(p_partkey % 9 = 0, ' !!! ', concat('  ', initcap(p_name), ' // ', p_type, ' (', p_size, ')! '))")
    return table(spark, sf_dir, "part").select(
        "p_partkey", slug(name).alias("slug"),
        detail_url(F.lit("https://shop.example/activity/9"), name, F.col("p_partkey")).alias("url"),
    )


@query("run_ids", "SELECT page_id, 'run_' || substr(sha1(url), 1, 12) AS run_id FROM pages")
def run_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", run_id(F.col("url")).alias("run_id"))


@query("product_keys", r"""
SELECT page_id,
  lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) ||
    rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS product_key
FROM pages""")
def product_keys(spark, sf_dir):
    """F3 on addresses disguised by case, port, end slash, query and fragment."""
    odd = F.expr(r"""regexp_replace(concat(replace(substring_index(substring_index(url, '#', 1), '?', 1), 'example', 'EXAMPLE'),
        if(page_id % 2 = 0, '/', ''), if(page_id % 3 = 0, '?ref=abc', ''), '#x'), '^(https?)://([^/]*)', '$1://$2:8080')""")
    return table(spark, sf_dir, "pages").select("page_id", product_key(odd).alias("product_key"))


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_BARE = "regexp_replace(url, '[?#].*$', '')"


@query("resolved_urls", f"""
SELECT page_id, ref, CASE ref
  WHEN '../img/a.jpg' THEN CASE WHEN depth >= 2 THEN up ELSE o || '/' END || 'img/a.jpg'
  WHEN './b?x=../y' THEN dir || 'b?x=../y'
  WHEN 'c//d/../e/.' THEN dir || 'c/e/'
  WHEN '/r/./s/../../t#f' THEN o || '/t#f'
  WHEN '?q=1' THEN bare || '?q=1'
  WHEN '#f' THEN nofrag || '#f'
  WHEN '//cdn.example/p' THEN regexp_extract(url, '^(https?:)', 1) || '//cdn.example/p'
  WHEN '' THEN url
  ELSE ref END AS resolved
FROM (SELECT *, dir0 AS dir, regexp_replace(dir0, '[^/]*/$', '') AS up,
        len(string_split(regexp_extract(dir0, '^https?://[^/]*(/.*)$', 1), '/')) - 1 AS depth
      FROM (SELECT page_id, url, {_ORIGIN} AS o, {_BARE} AS bare, regexp_replace(url, '#.*$', '') AS nofrag,
              regexp_replace({_BARE}, '[^/]*$', '') AS dir0 FROM pages)),
     (SELECT unnest(['../img/a.jpg', './b?x=../y', 'c//d/../e/.', '/r/./s/../../t#f', '?q=1', '#f',
                     '//cdn.example/p', '', 'mailto:a@b.example', 'HTTPS://Other.example/x']) AS ref)""")
def resolved_urls(spark, sf_dir):
    """ten kinds of reference against every page address."""
    refs = ["../img/a.jpg", "./b?x=../y", "c//d/../e/.", "/r/./s/../../t#f", "?q=1", "#f",
            "//cdn.example/p", "", "mailto:a@b.example", "HTTPS://Other.example/x"]
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.explode(F.array(*map(F.lit, refs))).alias("ref")
    ).select("page_id", "ref", resolve_url(F.col("url"), F.col("ref")).alias("resolved"))


@query("international_urls", """
SELECT page_id, CASE page_id % 4
   WHEN 0 THEN 'https://xn--bcher-kva.shop' || page_id || '.example/a%C3%A9/' || page_id
   WHEN 1 THEN 'https://a.example/b/c?d=e\\f'
   WHEN 2 THEN 'http://a' || page_id || '.example/x'
   ELSE 'https://me@xn--bcher-kva.example:8443/' || page_id END AS url
FROM pages""")
def international_urls(spark, sf_dir):
    """international hosts, backslashes, empty ports."""
    odd = F.expr(r"""case page_id % 4 when 0 then concat('https://BÜCHER.shop', page_id, '.example/aé/', page_id)
        when 1 then concat('https://a.example', chr(92), 'b', chr(92), 'c?d=e', chr(92), 'f')
        when 2 then concat('http://A', page_id, '.example:/x') else concat('https://me@Bücher.example:8443/', page_id) end""")
    return table(spark, sf_dir, "pages").select("page_id", canonical_url(odd).alias("url"))


@query("canonical_urls", """
SELECT page_id, CASE page_id % 5
   WHEN 0 THEN NULL
   WHEN 1 THEN 'http://a.example/'
   WHEN 2 THEN 'https://a.example:8443/x%20y/%C3%A9?q=%22z%22'
   WHEN 3 THEN 'https://a.example/b/' || page_id
   ELSE url END AS url
FROM pages""")
def canonical_urls(spark, sf_dir):
    """refused schemes, empty paths, ports, encoding, dot segments."""
    odd = F.expr("""case page_id % 5 when 0 then concat('ftp://a.example/', page_id) when 1 then 'HTTP://A.example:80'
        when 2 then 'https://A.EXAMPLE:8443/x y/é?q="z"' when 3 then concat(' https://a.example:443/a/../b/./', page_id)
        else url end""")
    return table(spark, sf_dir, "pages").select("page_id", canonical_url(odd).alias("url"))


@query("category_paths", """
SELECT p_partkey, CASE WHEN p_partkey % 6 = 4 THEN NULL ELSE p_type END AS category,
  CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN NULL WHEN 2 THEN p_brand WHEN 3 THEN 'Shop' WHEN 5 THEN 'a/b' END AS subcategory
FROM part""")
def category_paths(spark, sf_dir):
    """F14 and F16 on paths with four separators, roots and product names."""
    path = F.expr("""case p_partkey % 6
        when 0 then concat(' Home >> ', p_type, ' > ', p_brand, ' > x > ', p_name)
        when 1 then concat('Shop | all |', p_type, ' | ', upper(p_name))
        when 2 then concat('index/', p_type, '//', p_brand)
        when 3 then concat(p_type, ' › Shop › ', p_name)
        when 4 then ' Home '
        else concat(p_type, ' > a/b') end""")
    pair = category_pair(split_category_path(path), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", pair.alias("p")).select(
        "p_partkey", "p.category", "p.subcategory"
    )


@query("template_matches", GOODS + """
SELECT k, template, (template = '/details/*') OR (template = '/*/' || replace(name, ' ', '-') || '-' || k) AS fits
FROM g, LATERAL (SELECT unnest(['/details/*', '/details/*/x', '/item/*', '/*', '/*/' || replace(name, ' ', '-') || '-' || k]) AS template)""")
def template_matches(spark, sf_dir):
    """F9 on every product address."""
    templates = F.expr("array('/details/*', '/details/*/x', '/item/*', '/*', concat('/*/', replace(name, ' ', '-'), '-', k))")
    return goods(spark, sf_dir).select("k", "url", F.explode(templates).alias("template")).select(
        "k", "template", matches_template(F.col("url"), F.col("template")).alias("fits")
    )


_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))"


@query("parent_domains", f"""
SELECT page_id, array_to_string(list_transform(range(1, len(p)), lambda i: array_to_string(p[i:], '.')), ' ') AS domains
FROM (SELECT page_id, string_split({_HOST}, '.') AS p FROM pages)""")
def parent_domains(spark, sf_dir):
    """F6 as one text per page."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(domains_of(host_of(F.col("url"))), " ").alias("domains")
    )


@query("host_routing", f"""
WITH h AS (SELECT page_id, {_HOST} AS host FROM pages),
a AS (SELECT regexp_replace(host, '^[^.]*\\.', '') AS domain, min(CASE WHEN length(host) % 2 = 0 THEN 'api' ELSE 'sitemap' END) AS source
      FROM h WHERE host LIKE 'm.%' OR host LIKE 'www.%' GROUP BY 1)
SELECT page_id,
  CASE WHEN s.domain IS NOT NULL THEN s.domain ELSE p.domain END AS adapter,
  coalesce(CASE WHEN s.domain IS NOT NULL THEN s.source ELSE p.source END, 'generic') AS source
FROM h LEFT JOIN a AS s ON h.host = s.domain
  LEFT JOIN a AS p ON len(string_split(h.host, '.')) > 2 AND regexp_replace(h.host, '^[^.]*\\.', '') = p.domain""")
def host_routing(spark, sf_dir):
    """D18 with the parents of the mobile and www hosts as registered domains."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host like 'm.%' or host like 'www.%'")
    adapters = hosts.groupBy(F.expr(r"regexp_replace(host, '^[^.]*\\.', '')").alias("domain")).agg(
        F.min(F.expr("if(length(host) % 2 = 0, 'api', 'sitemap')")).alias("source")
    )
    return route(pages.select("page_id", "url"), adapters).select("page_id", "adapter", "source")


@query("requested_sources", """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'generic' WHEN 1 THEN 'browser' WHEN 2 THEN 'sitemap' END AS source,
  CASE WHEN o_orderkey % 4 = 3 THEN 'Unknown source ''csv''' END AS route_error
FROM orders""")
def requested_sources(spark, sf_dir):
    """An explicit source wins, an unknown one is an error."""
    runs = order_requests(spark, sf_dir).withColumn(
        "requested", F.expr("case run_id % 4 when 0 then 'auto' when 1 then 'browser' when 2 then 'sitemap' else 'csv' end")
    )
    adapters = table(spark, sf_dir, "nation").selectExpr("concat(lower(n_name), '.example') as domain", "'api' as source")
    return route(runs, adapters).select("run_id", "source", "route_error")
