"""Queries of the extraction strategies over rendered product pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.config import JobConfig
from shelfspark.operators.extract import (
    FIELDS,
    GENERIC_CHAIN,
    SITE_CHAIN,
    build_products,
    extract_fields,
)
from shelfspark.operators.parse import parse_pages
from shelfspark.operators.signals import signal_report, with_signals
from shelfspark.operators.taxonomy import builtin_taxonomy
from shelfspark.queries.registry import GOODS, money, query
from shelfspark.rendering import storefront as R


def _fields(pages, chain, column):
    """One strategy's fields per page."""
    spark = pages.sparkSession
    extracted = extract_fields(
        with_signals(parse_pages(pages)), chain, JobConfig(), builtin_taxonomy(spark)
    )
    return extracted.select(F.col("page_id").alias("k"), *[
        (money(f"{column}.{n}") if n in ("mrp", "asp") else F.col(f"{column}.{n}")).alias(n) for n in FIELDS
    ])


_IMAGE = "'https://' || host || '/img/' || k || '.jpg'"


def _cents(expr: str, name: str) -> str:
    return f"CAST(({expr}) / 100.0 AS DOUBLE) AS {name}"


_NO_CATEGORY = "CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS subcategory"


@query("extract_jsonld", GOODS + f"""
SELECT k, name, {_IMAGE} AS image_url, {_cents("CASE WHEN k % 5 <> 0 THEN mrp_c END", "mrp")}, {_cents("asp_c", "asp")},
  kind AS category, CASE WHEN k % 4 <> 3 THEN brand END AS subcategory FROM g""")
def extract_jsonld(spark, sf_dir):
    """E1 with broken blocks, nested nodes, four offer and three image shapes."""
    return _fields(R.product_pages(spark, sf_dir, "jsonld"), GENERIC_CHAIN, "structured")


@query("extract_microdata", GOODS + f"""
SELECT k, name, {_IMAGE} AS image_url,
  {_cents("CASE WHEN k % 4 < 2 THEN asp_c ELSE greatest(mrp_c, asp_c) END", "mrp")}, {_cents("asp_c", "asp")}, {_NO_CATEGORY} FROM g""")
def extract_microdata(spark, sf_dir):
    """Hints, the largest image, own prices beside carded ones."""
    return _fields(R.product_pages(spark, sf_dir, "microdata"), GENERIC_CHAIN, "heuristics")


@query("extract_selectors", GOODS + f"""
SELECT k, name, {_IMAGE} AS image_url, {_cents("mrp_c", "mrp")}, {_cents("CASE WHEN k % 4 <> 3 THEN asp_c END", "asp")}, {_NO_CATEGORY} FROM g""")
def extract_selectors(spark, sf_dir):
    """E3 with every default selector."""
    return _fields(R.product_pages(spark, sf_dir, "selectors"), SITE_CHAIN, "selectors")


@query("extract_og", GOODS + f"""
SELECT k, CASE WHEN k % 3 = 0 THEN name || ' & more' ELSE name END AS name,
  CASE WHEN k % 4 <> 0 THEN {_IMAGE} END AS image_url, CAST(NULL AS DOUBLE) AS mrp, CAST(NULL AS DOUBLE) AS asp, {_NO_CATEGORY} FROM g""")
def extract_og(spark, sf_dir):
    """E5."""
    return _fields(R.product_pages(spark, sf_dir, "og"), SITE_CHAIN, "fallback")


_LEVEL3 = "CASE k % 3 WHEN 0 THEN 'Backpacks' WHEN 1 THEN 'Dresses' END"


@query("extract_embedded", GOODS + f"""
SELECT k, name, {_IMAGE} AS image_url, {_cents("mrp_c", "mrp")}, {_cents("asp_c", "asp")},
  CASE k % 5 WHEN 0 THEN 'Bags' WHEN 2 THEN 'cat:' || (9000 + size) WHEN 4 THEN 'Denim' END AS category, {_LEVEL3} AS subcategory FROM g""")
def extract_embedded(spark, sf_dir):
    """Detail objects with decoy braces, ids of wrong types, unknown ids."""
    return _fields(R.product_pages(spark, sf_dir, "embedded"), SITE_CHAIN, "embedded")


@query("merge_gaps_site", GOODS + f"""
SELECT k, CASE WHEN k % 5 = 2 THEN 'Wrong ' || k ELSE name END AS name,
  CASE WHEN k % 5 = 2 AND k % 4 = 0 THEN NULL ELSE {_IMAGE} END AS image_url,
  {_cents("CASE WHEN k % 5 IN (1, 3, 4) THEN mrp_c END", "mrp")},
  {_cents("CASE WHEN k % 5 = 2 OR (k % 5 = 4 AND k % 4 = 3) THEN NULL ELSE asp_c END", "asp")},
  CASE WHEN k % 5 < 2 THEN kind END AS category,
  CASE WHEN k % 5 < 2 AND k % 4 <> 3 THEN brand WHEN k % 5 = 3 THEN {_LEVEL3} END AS subcategory FROM g""")
def merge_gaps_site(spark, sf_dir):
    """E7 and E8, the chain of a known site."""
    return _fields(R.mixed_pages(spark, sf_dir), SITE_CHAIN, "fields")


_GENERIC = GOODS + f""", m AS (SELECT *,
   CASE WHEN k % 5 = 4 AND k % 3 IN (0, 2) THEN mrp_c END AS sel_m, CASE WHEN k % 5 = 4 AND k % 4 IN (1, 2) THEN asp_c END AS sel_a FROM g),
x AS (SELECT k, host, CASE WHEN k % 5 = 4 AND k % 3 <> 0 THEN NULL ELSE name END AS name,
  CASE WHEN (k % 5 = 2 AND k % 4 = 0 AND k % 3 = 0) OR (k % 5 = 3 AND k % 3 = 0) THEN NULL ELSE {_IMAGE} END AS image_url,
  {_cents("CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN mrp_c WHEN 4 THEN coalesce(greatest(sel_m, sel_a), sel_m, sel_a) ELSE CASE WHEN k % 4 < 2 THEN asp_c ELSE greatest(mrp_c, asp_c) END END", "mrp")},
  {_cents("CASE WHEN k % 5 = 4 THEN coalesce(least(sel_m, sel_a), sel_m, sel_a) ELSE asp_c END", "asp")},
  CASE WHEN k % 5 < 2 THEN kind END AS category, CASE WHEN k % 5 < 2 AND k % 4 <> 3 THEN brand END AS subcategory, url FROM m)
"""


@query("merge_gaps_generic", _GENERIC + "SELECT k, name, image_url, mrp, asp, category, subcategory FROM x")
def merge_gaps_generic(spark, sf_dir):
    """E7 and E8, the chain of an unknown site."""
    return _fields(R.mixed_pages(spark, sf_dir), GENERIC_CHAIN, "fields")


@query("built_products", _GENERIC + """
SELECT k, name, image_url, mrp, asp, url AS product_url, substr(url, 9) AS product_key,
  name IS NOT NULL AND image_url IS NOT NULL AS usable FROM x""")
def built_products(spark, sf_dir):
    """Completeness and addresses; incomplete pages are marked, not lost."""
    extracted = extract_fields(with_signals(parse_pages(R.mixed_pages(spark, sf_dir))), GENERIC_CHAIN, JobConfig())
    rows = build_products(extracted, keep=("page_id",)).withColumnRenamed("page_id", "k")
    return rows.select("k", "name", "image_url", money("mrp").alias("mrp"), money("asp").alias("asp"), "product_url", "product_key", "usable")


@query("breadcrumb_pairs", """
SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_type END AS category,
  CASE WHEN p_partkey % 4 IN (0, 2) THEN p_brand END AS subcategory FROM part""")
def breadcrumb_pairs(spark, sf_dir):
    """B1, B2, B3, E2 and F16 on trails of three sources."""
    return _fields(R.breadcrumb_pages(spark, sf_dir), GENERIC_CHAIN, "breadcrumbs").select("k", "category", "subcategory")


@query("breadcrumb_trails", """
SELECT p_partkey AS k, CASE p_partkey % 4
  WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Home' ELSE 'SHOP' END || '>' || p_type || '>' || p_brand || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '>' || p_name END
  WHEN 1 THEN 'All>' || p_type || '>' || p_name
  WHEN 2 THEN 'Home>' || p_type || '>' || p_brand || '>' || p_name END AS trail FROM part""")
def breadcrumb_trails(spark, sf_dir):
    """The trails themselves, joined into one text."""
    pages = R.breadcrumb_pages(spark, sf_dir)
    extracted = extract_fields(with_signals(parse_pages(pages)), GENERIC_CHAIN, JobConfig())
    return extracted.select(F.col("page_id").alias("k"), F.array_join("crumbs", ">").alias("trail"))


_SIGNALS = """WITH s AS (
SELECT k, mrp_c, CAST(CASE m WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 + size % 5 WHEN 3 THEN 0 WHEN 4 THEN size % 3 ELSE 1 END AS BIGINT) AS n_prices,
  CAST(CASE WHEN m IN (0, 1, 5) THEN 1 ELSE 0 END AS BIGINT) AS n_free, m = 4 AS product_markup, m IN (0, 1, 4, 5) AS is_product_page, m
FROM (SELECT p_partkey AS k, p_size AS size, p_partkey % 6 AS m, CAST(round(p_retailprice * 100) AS BIGINT) + 100000 * (p_partkey % 3) AS mrp_c FROM part))
"""


@query("page_signals", _SIGNALS + """
SELECT k, n_prices, n_free, n_prices - n_free AS n_carded, product_markup, is_product_page,
  CASE WHEN n_free = 1 THEN CAST(mrp_c / 100.0 AS DOUBLE) END AS own_price FROM s""")
def page_signals(spark, sf_dir):
    """P1 to P6 on product pages, grids of any size and explicit markup."""
    s = with_signals(parse_pages(R.signal_pages(spark, sf_dir)))
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n_prices", "n_free", "n_carded")]
    return s.select(
        F.col("page_id").alias("k"), *counts, "product_markup", "is_product_page",
        money(F.array_max("own_prices")).alias("own_price"),
    )


@query("page_signal_report", _SIGNALS + """
SELECT CASE WHEN is_product_page THEN 'product' ELSE 'listing' END AS verdict, count(*) AS pages,
  CAST(sum(n_prices) AS BIGINT) AS prices, CAST(sum(n_free) AS BIGINT) AS free, CAST(sum(n_prices - n_free) AS BIGINT) AS carded
FROM s GROUP BY 1""")
def page_signal_report(spark, sf_dir):
    """P8."""
    return signal_report(with_signals(parse_pages(R.signal_pages(spark, sf_dir))))


@query("lazy_signals", "SELECT p_partkey AS k, p_partkey % 9 < 4 AS lazy_load FROM part")
def lazy_signals(spark, sf_dir):
    """D11 on live, disabled, hidden and lookalike controls."""
    from shelfspark.operators.pagination import with_lazy_signal

    pages = R.table(spark, sf_dir, "part").selectExpr("p_partkey as page_id", """concat('<div><p>', p_name, '</p>', case p_partkey % 9
        when 0 then '<button data-load-more>x</button>' when 1 then '<a href="#">  Show <b>more</b> items</a>'
        when 2 then '<span role="button">view more</span>' when 3 then '<button class="btn Load-More-btn">y</button>'
        when 4 then '<button class="load-more" disabled>x</button>' when 5 then '<button aria-disabled="true">Load more</button>'
        when 6 then '<a style="display: none">See more</a>' when 7 then '<a>Download more brochures</a>' else '<p>load more</p>' end, '</div>') as html""")
    return with_lazy_signal(parse_pages(pages)).select(F.col("page_id").alias("k"), "lazy_load")
