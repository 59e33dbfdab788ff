"""Queries of the listing feed, its enrichment and the taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.config import TAXONOMY_LEVEL2, TAXONOMY_LEVEL3, JobConfig
from shelfspark.operators import feed as G
from shelfspark.operators.enrich import detail_ids, enrich, enrichment_misses
from shelfspark.operators.taxonomy import builtin_taxonomy, merged_taxonomy, override_rows, unmapped
from shelfspark.plans.runs import feed_run
from shelfspark.queries.registry import GOODS, money, query
from shelfspark.rendering import storefront as R

_KIND = "CASE kind WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END"

#: Listings, where their drain ends, and the first listing of every id.
_FEED = f"""{GOODS}, e AS (
  SELECT *, row_number() OVER (PARTITION BY flow ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY flow) AS m
  FROM (SELECT k, name, host, mrp_c, asp_c, size, 100 + b AS flow FROM g UNION ALL SELECT k, name, host, mrp_c, asp_c, size, 200 + {_KIND} FROM g)),
pg AS (SELECT *, CAST(j // {R.PER_PAGE} + 1 AS BIGINT) AS page, CAST((m - 1) // {R.PER_PAGE} + 1 AS BIGINT) AS last, j % {R.PER_PAGE} AS pos FROM e),
st0 AS (SELECT flow, max(last) AS last, count(*) FILTER (page = last AND k % 40 <> 13) = 0 AS dry FROM pg GROUP BY flow),
st AS (SELECT flow, last,
  CASE WHEN flow < 200 AND flow % 5 = 1 AND last >= 3 THEN 3 WHEN flow < 200 AND flow % 5 IN (0, 2) AND NOT dry THEN last + 1 ELSE last END AS stop_page,
  (flow < 200 AND flow % 5 = 1 AND last >= 3) OR (flow < 200 AND flow % 5 = 2 AND NOT dry) AS failed FROM st0),
li AS (SELECT flow, row_number() OVER (ORDER BY CASE WHEN flow = 103 THEN 0 ELSE flow END) - 1 AS rank FROM (SELECT flow FROM st UNION SELECT 103)),
got AS (SELECT * FROM (
  SELECT pg.*, st.failed, li.rank, row_number() OVER (PARTITION BY k ORDER BY li.rank, page, pos) AS rn
  FROM pg JOIN st USING (flow) JOIN li USING (flow) WHERE k % 40 <> 13 AND page <= stop_page AND NOT (failed AND page = stop_page AND flow % 5 = 1)) WHERE rn = 1),
pr AS (SELECT *, 'https://shop.example/details/' || replace(name, ' ', '-') || '-' || k AS product_url FROM got WHERE k % 40 NOT IN (14, 15) AND k <> 0)
"""


def _listings(spark, sf_dir):
    return G.harvest_listings(R.feed_seed(spark, sf_dir), "https://shop.example")


@query("listing_harvest", _FEED + """
SELECT 'site' AS run_id, CAST(rank AS BIGINT) AS listing_rank, CAST(flow AS VARCHAR) AS flow_id, 'https://shop.example/activity/' || flow AS listing_url FROM li""")
def listing_harvest(spark, sf_dir):
    """Every listing linked from the home page, the seed's own first."""
    return _listings(spark, sf_dir).withColumn("listing_rank", F.col("listing_rank").cast("bigint"))


@query("feed_stops", _FEED + "SELECT CAST(flow AS VARCHAR) AS flow_id, stop_page, failed FROM st")
def feed_stops(spark, sf_dir):
    """Bad envelopes, repeated pages, HTTP errors, regular ends."""
    stops = G.drain_stops(G.listing_table(R.feed_pages(spark, sf_dir)))
    return stops.withColumn("stop_page", F.col("stop_page").cast("bigint"))


@query("feed_goods", _FEED + """
SELECT 'site' AS run_id, k AS goods_id, CAST(flow AS VARCHAR) AS flow_id, page AS page_index, CAST(pos AS BIGINT) AS pos FROM got""")
def feed_goods(spark, sf_dir):
    """Unique integer ids, the first listing wins."""
    pages = G.listing_table(R.feed_pages(spark, sf_dir))
    goods = G.first_goods(G.drained_goods(pages, G.drain_stops(pages)), _listings(spark, sf_dir))
    return goods.select(
        "run_id", "goods_id", "flow_id", F.col("page_index").cast("bigint").alias("page_index"), F.col("pos").cast("bigint").alias("pos")
    )


_VALUES = """k AS goods_id, name, 'https://' || host || '/img/' || k || '.jpg' AS image_url, CAST(mrp_c / 100.0 AS DOUBLE) AS mrp,
  CAST((CASE WHEN k % 3 = 0 THEN asp_c ELSE mrp_c END) / 100.0 AS DOUBLE) AS asp, product_url"""


@query("feed_products", _FEED + f"SELECT {_VALUES} FROM pr")
def feed_products(spark, sf_dir):
    """Usable records as products."""
    pages = G.listing_table(R.feed_pages(spark, sf_dir))
    goods = G.first_goods(G.drained_goods(pages, G.drain_stops(pages)), _listings(spark, sf_dir))
    return G.feed_products(goods, "https://shop.example/").select(
        "goods_id", "name", "image_url", money("mrp").alias("mrp"), money("asp").alias("asp"), "product_url"
    )


_DETAIL = "k % 10 NOT IN (3, 4, 5)"
_LEVEL2 = "CASE k % 5 WHEN 0 THEN 'Bags' WHEN 2 THEN 'cat:' || (9000 + size) WHEN 4 THEN 'Denim' END"
_LEVEL3 = "CASE k % 3 WHEN 0 THEN 'Backpacks' WHEN 1 THEN 'Dresses' END"


def _run(spark, sf_dir, **given):
    return feed_run(
        R.feed_pages(spark, sf_dir), _listings(spark, sf_dir), JobConfig(), details=R.detail_pages(spark, sf_dir), **given
    )


@query("feed_enriched", _FEED + f"""
SELECT {_VALUES}, CASE WHEN {_DETAIL} THEN {_LEVEL2} END AS category, CASE WHEN {_DETAIL} THEN {_LEVEL3} END AS subcategory, {_DETAIL} AS enriched FROM pr""")
def feed_enriched(spark, sf_dir):
    """Labels from detail pages, misses kept."""
    rows = _run(spark, sf_dir).settled
    return rows.select(
        "goods_id", "name", "image_url", money("mrp").alias("mrp"), money("asp").alias("asp"), "product_url", "category", "subcategory", "enriched"
    )


@query("feed_counters", _FEED + """
SELECT 'site' AS run_id, count(*) AS discovered, count(*) AS exported, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS duplicates,
  (SELECT count(*) FROM li LEFT JOIN st USING (flow) WHERE coalesce(failed, true)) AS failed, CAST(0 AS BIGINT) AS invalid FROM pr""")
def feed_counters(spark, sf_dir):
    """Q6 of a feed run: failed listings are counted, their rows are kept."""
    return _run(spark, sf_dir).counters


@query("feed_warnings", _FEED + f"""
SELECT 'site' AS run_id, 'No name for level2 category ' || (9000 + size) || '; exported as cat:' || (9000 + size) || '.' AS warning
FROM pr WHERE {_DETAIL} AND k % 5 = 2 GROUP BY size
UNION ALL SELECT 'site', count(*) || ' detail page(s) gave no category; their rows have none.' FROM pr WHERE NOT ({_DETAIL}) HAVING count(*) > 0""")
def feed_warnings(spark, sf_dir):
    """Q7, Q8 and G8."""
    return _run(spark, sf_dir).warnings


@query("feed_misses", _FEED + f"SELECT 'site' AS run_id, count(*) AS products, count(*) FILTER (NOT ({_DETAIL})) AS misses FROM pr")
def feed_misses(spark, sf_dir):
    """G8 as numbers."""
    return enrichment_misses(_run(spark, sf_dir).settled).drop("warning")


@query("feed_resumed", _FEED + """, todo AS (SELECT *, row_number() OVER (ORDER BY rank, page, pos) AS nth FROM pr WHERE k % 3 <> 1)
SELECT k AS goods_id, product_url FROM todo WHERE nth <= 37""")
def feed_resumed(spark, sf_dir):
    """Q3 and Q4 in a feed run: earlier keys skipped, the cap in listing order."""
    done = R.goods(spark, sf_dir).where("k % 3 = 1").selectExpr(
        "'site' as run_id", "concat('shop.example/details/', replace(name, ' ', '-'), '-', k) as product_key"
    )
    caps = R.feed_seed(spark, sf_dir).selectExpr("run_id", "37 as max_products")
    return _run(spark, sf_dir, processed=done, caps=caps).exported.select("goods_id", "product_url")


@query("feed_capped_counters", _FEED + """, todo AS (SELECT *, row_number() OVER (ORDER BY rank, page, pos) AS nth FROM pr)
SELECT 'site' AS run_id, count(*) FILTER (nth <= 137) AS exported,
  (SELECT count(*) FROM li LEFT JOIN st USING (flow) WHERE coalesce(failed, true) AND li.rank < coalesce((SELECT rank FROM todo WHERE nth = 137), 1000000)) AS failed FROM todo""")
def feed_capped_counters(spark, sf_dir):
    """Listings behind the product cap are neither read nor failed."""
    caps = R.feed_seed(spark, sf_dir).selectExpr("run_id", "137 as max_products")
    return _run(spark, sf_dir, caps=caps).counters.select("run_id", "exported", "failed")


@query("taxonomy_gaps", GOODS + """
SELECT DISTINCT 'level2' AS level, CAST(9000 + size AS BIGINT) AS id FROM g WHERE k % 10 NOT IN (3, 4, 5) AND k % 5 = 2""")
def taxonomy_gaps(spark, sf_dir):
    """Q7 straight from all detail pages."""
    ids = detail_ids(R.detail_pages(spark, sf_dir))
    return unmapped(ids, builtin_taxonomy(spark), "level2_id", "level3_id").select("level", "id")


def _values(level: str, names: dict) -> str:
    return ", ".join(f"('{level}', {i}, '{n}', 0)" for i, n in names.items())


@query("taxonomy_override", f"""
SELECT level, id, max_by(name, p) AS name FROM (
  SELECT * FROM (VALUES {_values("level2", TAXONOMY_LEVEL2)}, {_values("level3", TAXONOMY_LEVEL3)}) AS t(level, id, name, p)
  UNION ALL SELECT 'level2', n_nationkey, n_name, 1 FROM nation
  UNION ALL SELECT 'level3', 1000 + n_nationkey, n_name, 1 FROM nation WHERE n_nationkey % 2 = 0) GROUP BY level, id""")
def taxonomy_override(spark, sf_dir):
    """Override documents win; bad keys and broken documents are ignored."""
    docs = R.table(spark, sf_dir, "nation").selectExpr("""case n_nationkey % 2
        when 0 then concat('{"level2":{"', n_nationkey, '":"', n_name, '","x1":"bad"},"level3":{" ', 1000 + n_nationkey, '":"', n_name, '"}}')
        else concat('{"level2":{"', n_nationkey, '":"', n_name, '"},"level3":[1]}') end as body""")
    broken = R.table(spark, sf_dir, "region").selectExpr("concat('{\"level2\": {\"9\": ', r_name) as body")
    merged = merged_taxonomy(builtin_taxonomy(spark), override_rows(docs.unionByName(broken)))
    return merged.select("level", "id", "name")


@query("taxonomy_labels", f"""
SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE coalesce(a.name, 'cat:' || p_size) END AS category,
  coalesce(c.name, 'cat:' || (p_size + 40)) AS subcategory
FROM part LEFT JOIN (VALUES {_values("level2", TAXONOMY_LEVEL2)}) AS a(l, id, name, p) ON a.id = p_size
  LEFT JOIN (VALUES {_values("level3", TAXONOMY_LEVEL3)}) AS c(l, id, name, p) ON c.id = p_size + 40""")
def taxonomy_labels(spark, sf_dir):
    """F25 on sizes as category ids."""
    from shelfspark.operators.taxonomy import with_labels

    parts = R.table(spark, sf_dir, "part").selectExpr(
        "p_partkey as k", "if(p_partkey % 3 = 0, null, cast(p_size as bigint)) as l2", "cast(p_size + 40 as bigint) as l3"
    )
    # repeated ids: the smallest name counts, and no part is repeated
    repeated = builtin_taxonomy(spark).unionByName(builtin_taxonomy(spark).withColumn("name", F.concat("name", F.lit(" again"))))
    return with_labels(parts, repeated, "l2", "l3").select("k", "category", "subcategory")
