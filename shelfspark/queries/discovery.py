"""Queries of link discovery, walks, sitemaps and robots."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.config import JobConfig
from shelfspark.operators import clusters as C
from shelfspark.operators import pagination as P
from shelfspark.operators import sitemaps as M
from shelfspark.operators.links import links_by_selector, same_host_outlinks
from shelfspark.operators.parse import parse_pages
from shelfspark.operators.robots import robots_gate, robots_rules
from shelfspark.plans.runs import crawl_run, sitemap_run
from shelfspark.queries.registry import GOODS, money, query
from shelfspark.rendering import storefront as R
from shelfspark.session import cut_lineage

_P = f"""{GOODS}, p AS (
  SELECT DISTINCT brand, host, b, CAST(i // {R.PER_PAGE} AS BIGINT) AS p, CAST((n - 1) // {R.PER_PAGE} AS BIGINT) AS last,
    'https://' || host || '/collections/all' || CASE WHEN i < {R.PER_PAGE} THEN '' ELSE '?page=' || (i // {R.PER_PAGE} + 1) END AS page_url
  FROM g)
"""


@query("next_links", _P + """
SELECT page_url, CASE WHEN p < last THEN 'https://' || host || '/collections/all?page=' || (p + 2) END AS next_url FROM p""")
def next_links(spark, sf_dir):
    """rel=next, labels and numbers, with lookalikes on every grid."""
    parsed = parse_pages(R.listing_pages(spark, sf_dir))
    return P.with_next_link(parsed).select(F.col("url").alias("page_url"), "next_url")


@query("pagination_walk", _P + """
SELECT brand AS run_id, page_url AS page_key, p AS page_pos FROM p""")
def pagination_walk(spark, sf_dir):
    """D10 from every brand's seed to the end."""
    links = P.with_next_link(parse_pages(R.listing_pages(spark, sf_dir)))
    walked = P.walk_pages(R.shop_runs(spark, sf_dir), P.page_edges(links))
    return walked.withColumn("page_pos", F.col("page_pos").cast("bigint"))


@query("pagination_walk_capped", _P + """
SELECT brand AS run_id, page_url AS page_key, p AS page_pos,
  CASE WHEN last >= 2 THEN 'The walk ended at 3 listing pages; there may be more.' END AS warning
FROM p WHERE p < 3""")
def pagination_walk_capped(spark, sf_dir):
    """D10 with a cap of three pages and its warning."""
    links = P.with_next_link(parse_pages(R.listing_pages(spark, sf_dir)))
    walked = P.walk_pages(R.shop_runs(spark, sf_dir), P.page_edges(links), 3)
    notes = P.walk_warnings(walked, 3)
    return walked.join(notes, "run_id", "left").withColumn("page_pos", F.col("page_pos").cast("bigint"))


@query("links_by_selector", GOODS + f"""
SELECT CAST(-1 - (b * 1000000 + i // {R.PER_PAGE}) AS BIGINT) AS page_id, 'https://' || host || '/details/' || replace(name, ' ', '-') || '-' || k AS url
FROM g
UNION ALL SELECT DISTINCT CAST(-1 - (b * 1000000 + i // {R.PER_PAGE}) AS BIGINT), u
FROM g, LATERAL (SELECT unnest(['https://' || host || '/details/checkout', 'https://other.example/details/z-1']) AS u)""")
def selector_links(spark, sf_dir):
    """Links of every grid by the configured selector, once per product."""
    found = links_by_selector(parse_pages(R.listing_pages(spark, sf_dir)), ("page_id",), JobConfig().selectors.product_link)
    return found.select("page_id", F.regexp_replace("url", r"\?.*$", "").alias("url"))


#: Seed grid of a brand: its activity links and its first products by address.
_SEED = f"""{GOODS}, seed AS (
  SELECT brand, url, k, row_number() OVER (PARTITION BY brand ORDER BY url) AS rn, count(*) OVER (PARTITION BY brand) AS m
  FROM g WHERE i < {R.PER_PAGE}),
v AS (SELECT brand, max(m) AS m, least(max(m), 3) AS sampled, count(*) FILTER (rn <= 3 AND k % 50 <> 7) AS hits FROM seed GROUP BY brand),
d AS (SELECT brand, m, sampled, hits, m >= 3 AND hits * 2 > sampled AS good FROM v)
"""


@query("verified_clusters", _SEED + """
SELECT brand AS run_id, '/activity/*' AS template, CAST(30 AS BIGINT) AS n_urls, CAST(1 AS BIGINT) AS rank, CAST(3 AS BIGINT) AS sampled, CAST(0 AS BIGINT) AS hits, false AS verified FROM d
UNION ALL SELECT brand, '/details/*', CAST(m AS BIGINT), 2, CAST(sampled AS BIGINT), CAST(hits AS BIGINT), good FROM d WHERE m >= 3""")
def verified_clusters(spark, sf_dir):
    """The largest group of links is not the products."""
    pages, runs = R.shop_pages(spark, sf_dir), R.shop_runs(spark, sf_dir)
    seeds = R.listing_pages(spark, sf_dir).join(
        runs.select("run_id", F.col("seed_url").alias("url")), "url"
    )
    links = same_host_outlinks(parse_pages(seeds), ("run_id",)).join(runs, "run_id")
    shaped = cut_lineage(C.shaped_links(links))
    samples = cut_lineage(C.cluster_samples(shaped, C.candidate_clusters(shaped)))
    verdicts = C.product_verdicts(samples.select("product_key").distinct(), pages, JobConfig())
    verified = C.verify_clusters(samples, verdicts)
    return verified.select(
        "run_id", "template", "n_urls", F.col("rank").cast("bigint").alias("rank"), "sampled", "hits", "verified"
    )


@query("crawl_patterns", _SEED + """
SELECT brand AS run_id, CASE WHEN good THEN '/details/*' END AS template,
  CASE WHEN NOT good THEN CASE WHEN m >= 3 THEN 'Tried the 2 largest shapes of links (/activity/*, /details/*); their samples held no products.'
    ELSE 'Tried the 1 largest shapes of links (/activity/*); their samples held no products.' END END AS warning FROM d""")
def crawl_patterns(spark, sf_dir):
    """D6 for every brand shop."""
    return crawl_run(R.shop_runs(spark, sf_dir), R.shop_pages(spark, sf_dir), JobConfig()).patterns


_ROWS = _SEED + f""", r AS (
  SELECT g.*, g.i // {R.PER_PAGE} AS page, k % 50 = 7 AS lost, substr(url, 9) AS product_key FROM g JOIN d USING (brand) WHERE good)
"""
_PRODUCT = """name, kind AS category, CASE WHEN k % 4 <> 3 THEN brand END AS subcategory,
  'https://' || host || '/img/' || k || '.jpg' AS image_url, CAST((CASE WHEN k % 5 <> 0 THEN mrp_c END) / 100.0 AS DOUBLE) AS mrp,
  CAST(asp_c / 100.0 AS DOUBLE) AS asp, url AS product_url"""
_COLUMNS = ("run_id", "product_key", "name", "category", "subcategory", "image_url", "mrp", "asp", "product_url")


def _exported(result):
    return result.exported.withColumns({"mrp": money("mrp"), "asp": money("asp")}).select(*_COLUMNS)


@query("crawl_products", _ROWS + f"SELECT brand AS run_id, product_key, {_PRODUCT} FROM r WHERE NOT lost")
def crawl_products(spark, sf_dir):
    """Flagship: seed page to products for every brand shop."""
    return _exported(crawl_run(R.shop_runs(spark, sf_dir), R.shop_pages(spark, sf_dir), JobConfig()))


@query("crawl_counters", _ROWS + """
SELECT brand AS run_id, count(*) FILTER (NOT lost) AS discovered, count(*) FILTER (NOT lost) AS exported, CAST(0 AS BIGINT) AS skipped,
  CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (lost) AS failed, CAST(0 AS BIGINT) AS invalid FROM r GROUP BY brand""")
def crawl_counters(spark, sf_dir):
    """Q6 of the crawl."""
    return crawl_run(R.shop_runs(spark, sf_dir), R.shop_pages(spark, sf_dir), JobConfig()).counters


@query("single_product_seeds", GOODS + f"SELECT CAST(k AS VARCHAR) AS run_id, substr(url, 9) AS product_key, {_PRODUCT} FROM g")
def single_product_seeds(spark, sf_dir):
    """Runs that start on a page without links are about that product."""
    pages = R.product_pages(spark, sf_dir, "jsonld").withColumn("html", F.regexp_replace("html", "(?s)<a .*?</a>", ""))
    runs = pages.select(F.col("page_id").cast("string").alias("run_id"), F.col("url").alias("seed_url"))
    return _exported(crawl_run(runs, pages, JobConfig()))


_RESUMED = _ROWS + """, todo AS (SELECT *, sum(CASE WHEN lost THEN 0 ELSE 1 END) OVER (PARTITION BY brand ORDER BY page, url ROWS UNBOUNDED PRECEDING) AS nth
  FROM r WHERE k % 4 <> 1),
reached AS (SELECT * FROM todo WHERE nth < 5 + b OR (nth = 5 + b AND NOT lost))
"""


def _resumed(spark, sf_dir):
    """A crawl with keys of an earlier run and a product cap per shop."""
    done = R.goods(spark, sf_dir).where("k % 4 = 1").selectExpr("brand as run_id", "substring(url, 9) as product_key")
    caps = R.shop_runs(spark, sf_dir).selectExpr("run_id", "5 + cast(substring(run_id, 7) as int) as max_products")
    return crawl_run(R.shop_runs(spark, sf_dir), R.shop_pages(spark, sf_dir), JobConfig(), processed=done, caps=caps)


@query("crawl_resumed_counters", _RESUMED + """
, e AS (SELECT brand, arg_max(page, (page, url)) AS page, max_by(url, (page, url)) AS url, count(*) FILTER (NOT lost) AS n, max(5 + b) AS cap, count(*) FILTER (lost) AS failed FROM reached GROUP BY brand),
s AS (SELECT r.brand, count(*) AS skipped FROM r LEFT JOIN e USING (brand)
  WHERE k % 4 = 1 AND (coalesce(e.n, 0) < coalesce(e.cap, 1) OR (r.page, r.url) < (e.page, e.url)) GROUP BY r.brand)
SELECT brand AS run_id, CAST(coalesce(n, 0) AS BIGINT) AS exported, CAST(coalesce(skipped, 0) AS BIGINT) AS skipped, CAST(coalesce(failed, 0) AS BIGINT) AS failed
FROM (SELECT DISTINCT brand FROM r) LEFT JOIN e USING (brand) LEFT JOIN s USING (brand)""")
def crawl_resumed_counters(spark, sf_dir):
    """Q3, Q4 and Q6: known links count only up to the cap's end."""
    return _resumed(spark, sf_dir).counters.select("run_id", "exported", "skipped", "failed")


@query("crawl_resumed_products", _RESUMED + f"SELECT brand AS run_id, product_key, {_PRODUCT} FROM reached WHERE NOT lost")
def crawl_resumed_products(spark, sf_dir):
    """Q3 and Q4 inside a crawl: pages of known keys are not parsed, but for seeds and samples; the cap ends a run."""
    return _exported(_resumed(spark, sf_dir))


# --------------------------------------------------------------------------
# Sitemaps
# --------------------------------------------------------------------------
_TREE = f"""{GOODS}, t AS (SELECT DISTINCT brand, host, b, (n - 1) // {R.SHARD} AS s_last, 'https://' || host AS o FROM g),
docs AS (
  SELECT brand, o || CASE WHEN b % 3 = 0 THEN '/maps/index.xml' ELSE '/sitemap.xml' END AS url, 1 AS rank, false AS in_branch FROM t
  UNION ALL SELECT brand, o || '/sm/products-index.xml', 2, true FROM t WHERE b % 3 <> 2
  UNION ALL SELECT brand, o || '/sm/products-gone.xml', 3, true FROM t WHERE b % 3 <> 2
  UNION ALL SELECT brand, o || '/sm/products-' || s || '.xml.gz', 4 + s, true FROM t, LATERAL (SELECT unnest(range(0, s_last + 1)) AS s) WHERE b % 3 <> 2)
"""


@query("sitemap_locations", _TREE + f"""
, shard AS (SELECT 'https://' || host || '/sm/products-' || (i // {R.SHARD}) || '.xml.gz' AS url, count(*) AS n FROM g WHERE b % 3 <> 2 GROUP BY 1),
flat AS (SELECT 'https://' || host || '/sitemap.xml' AS url, count(*) AS n FROM g WHERE b % 3 = 2 GROUP BY 1)
SELECT url, CAST(0 AS BIGINT) AS nested, n + 1 AS pages FROM shard
UNION ALL SELECT url, 0, n FROM flat
UNION ALL SELECT o || CASE WHEN b % 3 = 0 THEN '/maps/index.xml' ELSE '/sitemap.xml' END, 3, 0 FROM t WHERE b % 3 <> 2
UNION ALL SELECT o || '/sm/products-index.xml', s_last + 1, 0 FROM t WHERE b % 3 <> 2
UNION ALL SELECT o || '/sm/categories.xml', 0, 1 FROM t WHERE b % 3 <> 2""")
def sitemap_locations(spark, sf_dir):
    """Locations per readable document, gzip and namespaces included."""
    return M.parse_sitemaps(R.shop_sitemaps(spark, sf_dir)).groupBy("url").agg(
        F.sum(F.size("nested")).alias("nested"), F.sum(F.size("pages")).alias("pages")
    )


@query("sitemap_walk", _TREE + "SELECT brand AS run_id, url, CAST(rank AS BIGINT) AS rank, in_branch FROM docs")
def sitemap_walk(spark, sf_dir):
    """Documents in visiting order."""
    parsed = M.parse_sitemaps(R.shop_sitemaps(spark, sf_dir))
    roots = M.sitemap_roots(R.shop_runs(spark, sf_dir), R.shop_robots(spark, sf_dir))
    return M.walk_sitemaps(roots, parsed).withColumn("rank", F.col("rank").cast("bigint"))


@query("sitemap_walk_capped", _TREE + """, r AS (SELECT brand AS run_id, url, CAST(rank AS BIGINT) AS rank FROM docs WHERE rank <= 5)
SELECT r.*, CASE WHEN n >= 5 THEN 'The sitemap walk ended at 5 documents; there may be more.' END AS warning
FROM r JOIN (SELECT run_id, count(*) AS n FROM r GROUP BY 1) USING (run_id)""")
def sitemap_walk_capped(spark, sf_dir):
    """D15 with a cap of five documents and its warning."""
    parsed = M.parse_sitemaps(R.shop_sitemaps(spark, sf_dir))
    roots = M.sitemap_roots(R.shop_runs(spark, sf_dir), R.shop_robots(spark, sf_dir))
    visited = M.walk_sitemaps(roots, parsed, 5)
    return visited.join(M.cap_warnings(visited, 5, "documents"), "run_id", "left").select(
        "run_id", "url", F.col("rank").cast("bigint").alias("rank"), "warning")


_LISTED = f"""{GOODS}, u AS (SELECT brand, host, b, k, url, i, i // {R.SHARD} AS s, i % {R.SHARD} AS pos, name, kind, asp_c, mrp_c FROM g
  WHERE b % 3 <> 2)
"""


@query("sitemap_products", _LISTED + "SELECT brand AS run_id, url, CAST(4 + s AS BIGINT) AS rank, CAST(pos AS BIGINT) AS pos FROM u")
def sitemap_products(spark, sf_dir):
    """Product URLs on the shop's own host in document order."""
    runs = R.shop_runs(spark, sf_dir)
    parsed = M.parse_sitemaps(R.shop_sitemaps(spark, sf_dir))
    visited = M.walk_sitemaps(M.sitemap_roots(runs, R.shop_robots(spark, sf_dir)), parsed)
    urls = M.sitemap_product_urls(visited, parsed, runs)
    return urls.select("run_id", "url", F.col("rank").cast("bigint").alias("rank"), F.col("pos").cast("bigint").alias("pos"))


_CHECKED = _SEED.replace("WITH g0", "WITH g0", 1) + f""",
u AS (SELECT * FROM g WHERE b % 3 <> 2),
c AS (SELECT brand, count(*) AS n_urls, least(count(*), 3) AS n3, count(*) FILTER (i < 3 AND k % 50 <> 7) AS h3 FROM u GROUP BY brand),
src AS (SELECT t.brand, t.host, t.b, c.n_urls, coalesce(h3 * 2 > n3, false) AS site, c.brand IS NOT NULL AS listed, d.good
  FROM (SELECT DISTINCT brand, host, b FROM g) t LEFT JOIN c USING (brand) JOIN d USING (brand))
"""


@query("sitemap_sources", _CHECKED + """
SELECT brand AS run_id, CASE WHEN site THEN 'sitemap' ELSE 'generic' END AS source,
  CASE WHEN site THEN 'sitemap https://' || host || '/sm/products-0.xml.gz (' || n_urls || ' product URLs)' WHEN good THEN '/details/*' END AS template FROM src""")
def sitemap_sources(spark, sf_dir):
    """Sampled sitemaps, and shape clustering where there is none that holds."""
    result = sitemap_run(
        R.shop_runs(spark, sf_dir), R.shop_robots(spark, sf_dir), R.shop_sitemaps(spark, sf_dir), R.shop_pages(spark, sf_dir), JobConfig()
    )
    return result.patterns


@query("sitemap_run_products", _CHECKED + f"""
SELECT brand AS run_id, substr(url, 9) AS product_key, {_PRODUCT} FROM g JOIN src USING (brand, host, b)
WHERE k % 50 <> 7 AND (site OR good)""")
def sitemap_run_products(spark, sf_dir):
    """The whole sitemap run with its fallback."""
    return _exported(sitemap_run(
        R.shop_runs(spark, sf_dir), R.shop_robots(spark, sf_dir), R.shop_sitemaps(spark, sf_dir), R.shop_pages(spark, sf_dir), JobConfig()
    ))


# --------------------------------------------------------------------------
# Robots
# --------------------------------------------------------------------------
_GATE = """CASE m WHEN 2 THEN false WHEN 3 THEN p LIKE '10%' OR p NOT LIKE '1%' WHEN 4 THEN p NOT LIKE '2%' WHEN 5 THEN p NOT LIKE '35%' ELSE true END"""
_REASON = """CASE WHEN m = 0 THEN 'allowed: no robots.txt was captured' WHEN m = 1 THEN 'allowed: robots.txt answered HTTP 404'
  WHEN allowed THEN 'allowed: robots.txt has no rule against it' ELSE o || '/robots.txt forbids ' || url END"""


@query("robots_gate", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, allowed, {_REASON} AS reason FROM (SELECT *, {_GATE} AS allowed FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 6 AS m, CAST(l_partkey AS VARCHAR) AS p, 'https://supplier-' || l_suppkey || '.example' AS o,
    'https://supplier-' || l_suppkey || '.example/details/' || l_partkey || '?n=1' AS url FROM lineitem))""")
def robots_checked(spark, sf_dir):
    """D17 for a URL per line item against every supplier's robots file."""
    urls = R.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "concat('https://supplier-', l_suppkey, '.example/details/', l_partkey, '?n=1') as url",
    )
    rules = robots_rules(R.supplier_robots(spark, sf_dir), JobConfig().user_agent)
    return robots_gate(urls, rules).drop("url")
