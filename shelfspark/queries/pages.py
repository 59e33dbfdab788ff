"""Queries over the given page captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.config import NON_PRODUCT_SEGMENTS
from shelfspark.functions.urls import bare_url, canonical_url, host_of, product_key
from shelfspark.operators import clusters as C
from shelfspark.operators.extract import fallback_fields
from shelfspark.operators.links import same_host_outlinks
from shelfspark.operators.pagination import with_lazy_signal, with_next_link
from shelfspark.operators.parse import parse_pages
from shelfspark.operators.ranking import first_per_key
from shelfspark.operators.signals import signal_report, with_signals
from shelfspark.queries.registry import encoded, query
from shelfspark.rendering.storefront import table

_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query("pages_titles_dedup", f"""
SELECT product_key, page_id, title FROM (
  SELECT {_HOST} || rtrim({encoded(_PATH)}, '/') AS product_key, page_id,
    nullif(trim(replace(regexp_extract(html, '<title>([^<]*)', 1), '&amp;', '&')), '') AS title,
    row_number() OVER (PARTITION BY {_HOST} || rtrim({encoded(_PATH)}, '/') ORDER BY page_id) AS rn
  FROM pages) WHERE rn = 1""")
def pages_titles_dedup(spark, sf_dir):
    """One title per page identity: parse where the bodies lie, then choose among narrow rows."""
    pages = table(spark, sf_dir, "pages").withColumn("product_key", product_key(canonical_url(F.col("url"))))
    titled = parse_pages(pages).select("product_key", "page_id", fallback_fields()["name"].alias("title"))
    return first_per_key(titled, ["product_key"], "page_id")


@query("page_nodes", """
SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(<script>).*?</script>|<!--.*?-->', '\\1', 'gs'), '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages)
GROUP BY 1, 2""")
def page_nodes(spark, sf_dir):
    """H1 and H2: nodes per tag of every capture."""
    parsed = parse_pages(table(spark, sf_dir, "pages").select("page_id", "html"))
    tags = parsed.select("page_id", F.explode(F.transform("nodes", lambda n: n["tag"])).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_LINKS = f"""SELECT DISTINCT page_id, {_HOST} AS host,
    regexp_extract(url, '^(https?)', 1) || '://' || {_HOST} || {encoded("href")} AS url
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


@query("page_outlinks", f"SELECT page_id, url FROM ({_LINKS})")
def page_outlinks(spark, sf_dir):
    """Distinct same-host links of every capture."""
    parsed = parse_pages(table(spark, sf_dir, "pages"))
    return same_host_outlinks(parsed, ("page_id",)).select("page_id", "url")


def host_candidates(spark, sf_dir):
    """Links and addresses of every host's pages, clustered per host."""
    pages = table(spark, sf_dir, "pages")
    links = same_host_outlinks(parse_pages(pages), ("page_id",)).select("url")
    own = pages.select(bare_url(canonical_url(F.col("url"))).alias("url"))
    return links.unionByName(own).distinct().withColumn("run_id", host_of(F.col("url")))


_BLOCKED = ", ".join(f"'{s}'" for s in NON_PRODUCT_SEGMENTS)
_SHAPED = f"""WITH c AS (
  SELECT DISTINCT host AS run_id, url FROM ({_LINKS})
  UNION SELECT {_HOST}, regexp_extract(url, '^(https?)', 1) || '://' || {_HOST} || {encoded(_PATH)} FROM pages),
s AS (SELECT run_id, url, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS seg FROM c),
l AS (SELECT run_id, url, seg, CAST(len(seg) AS BIGINT) AS depth, CASE WHEN len(seg) > 1 THEN seg[1] ELSE '' END AS first_segment
  FROM s WHERE len(seg) > 0 AND NOT list_has_any(list_transform(seg, lambda x: lower(x)), [{_BLOCKED}])),
bk AS (SELECT run_id, depth, first_segment, count(*) AS n_urls, min(url) AS first_url FROM l GROUP BY ALL),
part_of AS (SELECT run_id, depth, first_segment, pos, CASE WHEN min(x) = max(x) THEN min(x) ELSE '*' END AS x
  FROM (SELECT run_id, depth, first_segment, unnest(seg) AS x, generate_subscripts(seg, 1) AS pos FROM l) GROUP BY ALL),
tm AS (SELECT run_id, depth, first_segment, '/' || string_agg(x, '/' ORDER BY pos) AS template FROM part_of GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n_urls DESC, first_url) AS rank FROM bk WHERE n_urls >= 3)
"""


@query("url_buckets", _SHAPED + "SELECT * FROM bk")
def url_buckets(spark, sf_dir):
    """F7, F8, D2."""
    shaped = C.shaped_links(host_candidates(spark, sf_dir))
    return C.url_buckets(shaped).withColumn("depth", F.col("depth").cast("bigint"))


@query("url_templates", _SHAPED + "SELECT * FROM tm")
def url_templates(spark, sf_dir):
    """D3."""
    shaped = C.shaped_links(host_candidates(spark, sf_dir))
    return C.bucket_templates(shaped).select(
        "run_id", F.col("depth").cast("bigint").alias("depth"), "first_segment", "template"
    )


@query("candidate_clusters", _SHAPED + """
SELECT run_id, depth, first_segment, n_urls, first_url, rank, template
FROM rk JOIN tm USING (run_id, depth, first_segment) WHERE rank <= 4""")
def candidate_clusters(spark, sf_dir):
    """D4."""
    found = C.candidate_clusters(C.shaped_links(host_candidates(spark, sf_dir)))
    return found.withColumn("depth", F.col("depth").cast("bigint")).withColumn("rank", F.col("rank").cast("bigint"))


@query("page_verdicts", """
SELECT 'listing' AS verdict, count(*) AS pages, CAST(0 AS BIGINT) AS prices, CAST(0 AS BIGINT) AS free, CAST(0 AS BIGINT) AS carded FROM pages""")
def page_verdicts(spark, sf_dir):
    """P8 on captures without any price."""
    return signal_report(with_signals(parse_pages(table(spark, sf_dir, "pages"))))


@query("page_navigation", """
SELECT page_id, CAST(NULL AS VARCHAR) AS next_url, false AS lazy_load FROM pages""")
def page_navigation(spark, sf_dir):
    """D8 and D11 on captures that have neither."""
    parsed = with_lazy_signal(with_next_link(parse_pages(table(spark, sf_dir, "pages"))))
    return parsed.select("page_id", "next_url", "lazy_load")
