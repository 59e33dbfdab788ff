"""Links of captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import nodes as N
from shelfspark.functions.urls import absolute_url, bare_url, canonical_url, host_of, origin_of, product_key, resolve_url


def hrefs(nodes: Column | str, selector: str = "a[href]") -> Column:
    """Non-empty link targets in document order, as written."""
    return F.filter(
        F.transform(N.select(nodes, selector), lambda n: N.attr(n, "href")), lambda h: h != ""
    )


def own_links(url: Column, nodes: Column | str = "nodes") -> Column:
    """Distinct absolute links of a page to its own host, query and fragment dropped.

    All of it is done inside the row, so only link texts leave it.
    """
    absolute = F.transform(F.array_distinct(hrefs(nodes)), lambda h: absolute_url(url, h))
    site = F.concat(origin_of(url), F.lit("/"))
    own = F.filter(absolute, lambda u: F.startswith(u, site) | (host_of(u) == host_of(url)))
    return F.array_distinct(F.transform(own, bare_url))


def same_host_outlinks(parsed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Distinct ``(keys…, url)``: absolute links on the page's own host."""
    # outer: a plain explode would compute the links a second time to filter on them
    links = parsed.select(*keys, F.explode_outer(own_links(F.col("url"))).alias("url"))
    return links.where(F.col("url").isNotNull()).distinct()


def links_by_selector(parsed: DataFrame, keys: tuple[str, ...], selector: str) -> DataFrame:
    """Product links by a configured selector, one row per product key.

    ``ord`` is the place of the first link to that product on the page.
    """
    found = parsed.select(
        *keys, F.col("url").alias("_page"), F.posexplode(hrefs("nodes", selector)).alias("ord", "_href")
    )
    absolute = found.select(
        *keys, "ord", canonical_url(resolve_url(F.col("_page"), F.col("_href"))).alias("url")
    ).where(F.col("url").isNotNull())
    return (
        absolute.withColumn("product_key", product_key(F.col("url")))
        .groupBy(*keys, "product_key")
        .agg(F.min("ord").alias("ord"), F.min_by("url", "ord").alias("url"))
    )
