"""Whole runs, from captured inputs to settled product rows.

Each plan returns a :class:`RunResult` of DataFrames; nothing but checkpoints of
the page and sitemap walks is computed before a sink asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.config import JobConfig
from shelfspark.functions.urls import canonical_url, host_of, matches_template, product_key
from shelfspark.operators import clusters as C
from shelfspark.operators import feed as G
from shelfspark.operators import pagination as P
from shelfspark.operators import sitemaps as M
from shelfspark.operators.enrich import detail_ids, enrich, enrichment_misses
from shelfspark.operators.extract import GENERIC_CHAIN, build_products, extract_fields, looks_like_product
from shelfspark.operators.links import own_links
from shelfspark.operators.membership import keep_members
from shelfspark.operators.parse import parse_pages
from shelfspark.operators.quality import before_cap, cap_ends, count_skipped, cut_at, settle, split_processed
from shelfspark.operators.ranking import first_n, first_per_key
from shelfspark.operators.reports import run_counters, run_warnings
from shelfspark.operators.signals import with_signals
from shelfspark.operators.taxonomy import builtin_taxonomy, unmapped
from shelfspark.session import cut_lineage, stored
from shelfspark.sources.captures import capture_index, captures_of_hosts, readable


SINGLE_PAGE = "single product page"
NO_PRODUCT = "No product links on the seed page, and it is no product itself."
NO_PATTERN = (
    "The seed page has links, but no shape of link leads to products; "
    "an adapter for the site would help."
)


@dataclass
class RunResult:
    """``settled`` has one row per product met, with its outcome."""

    settled: DataFrame
    counters: DataFrame
    warnings: DataFrame
    patterns: DataFrame | None = None

    @property
    def exported(self) -> DataFrame:
        return self.settled.where("outcome = 'exported'")


def feed_run(
    listing_pages: DataFrame,
    listings: DataFrame,
    config: JobConfig,
    details: DataFrame | None = None,
    processed: DataFrame | None = None,
    caps: DataFrame | None = None,
    taxonomy: DataFrame | None = None,
) -> RunResult:
    """Drain the listings of every run, de-duplicate, enrich, settle.

    ``listings`` is ``(run_id, listing_rank, flow_id)``.
    """
    spark = listing_pages.sparkSession
    pages = G.listing_table(listing_pages)
    stops = stored(G.drain_stops(pages))
    goods = G.first_goods(G.drained_goods(pages, stops, config.max_pages_per_listing), listings)
    products = stored(G.feed_products(goods, config.base_url))
    known = None
    if processed is not None:
        products, known = split_processed(products, processed)
        known = stored(known)
    # which rows a run exports does not depend on their categories
    ends = stored(cap_ends(settle(products), caps)) if caps is not None else None
    extra = [G.failed_listings(stops, listings, config.max_pages_per_listing, ends)]
    if known is not None:
        extra.append(count_skipped(known, ends))
    notes = []
    if config.with_categories and details is not None:
        names = taxonomy if taxonomy is not None else builtin_taxonomy(spark)
        wanted = _reached(products, ends).select("product_key")  # a run reads no detail page behind its cap
        products = stored(enrich(products, detail_ids(details, wanted), names))
        reached = _reached(products, ends)
        notes = [enrichment_misses(reached)]
        # one row per unnamed id and run that met it
        met = reached.select("run_id", F.explode(F.array(
            F.struct(F.lit("level2").alias("level"), F.col("level2_id").alias("id")),
            F.struct(F.lit("level3").alias("level"), F.col("level3_id").alias("id")),
        )).alias("p")).select("run_id", "p.level", "p.id").where("id is not null").distinct()
        notes.append(met.join(
            unmapped(reached, names, "level2_id", "level3_id"), ["level", "id"]
        ).select("run_id", "warning"))
    settled = settle(products) if ends is None else cut_at(settle(products), ends)
    counters = run_counters(settled, *extra)
    return RunResult(settled, counters, run_warnings(settled, counters, *notes))


def _reached(rows: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Rows up to the last one a capped run exports."""
    if ends is None:
        return rows
    return rows.join(ends, "run_id", "left").where("_end IS NULL OR discovery_ord <= _end").drop("_end")


def _settled(rows: DataFrame, caps: DataFrame | None, known: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """Settled rows, stored once, and the counts of known links before each run's end."""
    whole, ends = settle(rows), None
    if caps is not None:
        whole = stored(whole)
        ends = stored(cap_ends(whole, caps))
        whole = cut_at(whole, ends)
    return stored(whole), [count_skipped(known, ends)] if known is not None else []


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, url, page_key, links, next_url`` of captures: what a listing page is asked for."""
    captured = readable(pages).select("page_id", canonical_url(F.col("url")).alias("url"), "html")
    parsed = P.with_next_link(parse_pages(captured)).withColumn("links", own_links(F.col("url")))
    return parsed.select("page_id", "url", P.page_key(F.col("url")).alias("page_key"), "links", "next_url")


def page_facts(pages: DataFrame, config: JobConfig) -> DataFrame:
    """Everything later steps ask of a capture, from one parse of it.

    ``product_key, page_key, url, links, next_url``, the verdict ``hit`` of the
    sampling test, and the product fields.  A map over the captures: documents
    are never shuffled, and what a caller does not select is not computed.
    """
    captured = readable(pages).select("page_id", canonical_url(F.col("url")).alias("url"), "html")
    parsed = P.with_next_link(parse_pages(captured)).withColumn("links", own_links(F.col("url")))
    extracted = extract_fields(with_signals(parsed), GENERIC_CHAIN, config).withColumn(
        "hit", looks_like_product(F.col("fields"), F.col("is_product_page"))
    ).withColumn("page_key", P.page_key(F.col("url")))
    rows = build_products(extracted, keep=("page_id", "url", "page_key", "links", "next_url", "hit"))
    return rows.drop("product_url")


def _by_page(facts: DataFrame) -> DataFrame:
    """Links and next page of the first capture of every listing address."""
    return first_per_key(facts.select("page_id", "url", "page_key", "links", "next_url"), ["page_key"], "page_id")


def _by_product(facts: DataFrame) -> DataFrame:
    """Product fields and verdict of the first capture of every product key."""
    return first_per_key(facts.drop("url", "page_key", "links", "next_url"), ["product_key"], "page_id").drop("page_id")


def _seeds(runs: DataFrame, listing: DataFrame) -> DataFrame:
    """``(run_id, seed_url, links)`` of captured seeds."""
    return cut_lineage(
        runs.withColumn("page_key", P.page_key(F.col("seed_url"))).join(listing, "page_key").select("run_id", "seed_url", "links")
    )


def _samples(seeds: DataFrame) -> DataFrame:
    """The links that decide about the shapes of each seed's links."""
    shaped = C.shaped_links(seeds.select("run_id", "seed_url", F.explode("links").alias("url")).distinct())
    return C.cluster_samples(shaped, C.candidate_clusters(shaped))


def linked_products(links: DataFrame, facts: DataFrame) -> DataFrame:
    """Product rows of ``(run_id, discovery_ord, url, product_key)``, of facts by product key.

    A link without a capture becomes a failed row.
    """
    joined = links.join(facts, "product_key", "left")
    return stored(joined.withColumn("usable", F.coalesce("usable", F.lit(False))).withColumnRenamed("url", "product_url"))


def _first_links(links: DataFrame) -> DataFrame:
    """Every product key of a run once, in the order it is met."""
    keyed = links.withColumn("product_key", product_key(F.col("url")))
    return first_per_key(keyed, ["run_id", "product_key"], "discovery_ord")


class _Stored:
    """What a crawl asks of captures, from a stored ``page_facts`` table."""

    def __init__(self, facts: DataFrame):
        self.listing, self.by_product = stored(_by_page(facts)), stored(_by_product(facts))

    def seeds(self, runs: DataFrame) -> DataFrame:
        return _seeds(runs, self.listing)

    def verdicts(self, samples: DataFrame) -> DataFrame:
        return self.by_product

    def walk(self, walking: DataFrame, max_pages: int) -> tuple[DataFrame, DataFrame]:
        """(pages of every run in order, links of the pages)."""
        return P.walk_pages(walking, P.page_edges(self.listing), max_pages), self.listing

    def products(self, links: DataFrame, runs: DataFrame, caps: DataFrame | None) -> DataFrame:
        return self.by_product


class _Captures(_Stored):
    """The same from captures. Which are parsed is decided on their addresses alone, and bodies
    are filtered where they are read."""

    def __init__(self, pages: DataFrame, runs: DataFrame, config: JobConfig):
        self.config = config
        self.pages = readable(pages)
        index = capture_index(pages).withColumns({"page_key": P.page_key(F.col("url")), "host": host_of(F.col("url"))})
        self.index = stored(index.join(runs.select(host_of(F.col("seed_url")).alias("host")).distinct(), "host", "left_semi"))

    def _wanted(self, captures: DataFrame) -> DataFrame:
        return keep_members(self.pages, captures, "page_id")

    def _links(self, wanted: DataFrame) -> DataFrame:
        """Links and next page of wanted addresses."""
        keys = wanted.select("page_key").distinct()
        return stored(_by_page(page_links(self._wanted(wanted))).join(keys, "page_key", "left_semi"))

    def seeds(self, runs: DataFrame) -> DataFrame:
        keys = runs.select(P.page_key(F.col("seed_url")).alias("page_key"))
        self.listing = self._links(self.index.join(keys, "page_key", "left_semi"))
        return _seeds(runs, self.listing)

    def verdicts(self, samples: DataFrame) -> DataFrame:
        return C.product_verdicts(samples.select("product_key").distinct(), self.pages, self.config)

    def walk(self, walking: DataFrame, max_pages: int) -> tuple[DataFrame, DataFrame]:
        shapes = walking.select(host_of(F.col("seed_url")).alias("host"), "template").distinct()
        there = self.index.join(shapes.groupBy("host").agg(F.collect_set("template").alias("_templates")), "host")
        there = there.join(self.listing.select("page_key"), "page_key", "left_anti")
        product = F.exists("_templates", lambda t: matches_template(F.col("url"), t))
        others = there.where(~product)
        while True:
            self.listing = self.listing.unionByName(self._links(others))
            edges = P.page_edges(self.listing)
            walked = P.walk_pages(walking, edges, max_pages)
            # a next page that has the shape of a product: then such pages may list products too
            ahead = walked.join(edges, "page_key").select(F.col("next_key").alias("page_key")).distinct()
            missed = there.join(ahead, "page_key", "left_semi").join(self.listing.select("page_key"), "page_key", "left_anti")
            if missed.isEmpty():
                return walked, self.listing
            others = there.join(missed.select("host").distinct(), "host", "left_semi").join(self.listing.select("page_key"), "page_key", "left_anti")

    def products(self, links: DataFrame, runs: DataFrame, caps: DataFrame | None) -> DataFrame:
        """Facts of the links that are to be settled: all, or for a run with a cap the first
        ones, four times as many each round, until the cap is met or no link is left."""
        alone = runs.select(product_key(F.col("seed_url")).alias("product_key"))
        if caps is None:
            return self._chunk(links.select("product_key").unionByName(alone).distinct())
        links = stored(links)
        cap = F.when(F.col("max_products") > 0, F.col("max_products").cast("long"))
        sizes = links.groupBy("run_id").agg(F.count(F.lit(1)).alias("_all")).join(caps.select("run_id", cap.alias("_cap")), "run_id", "left")
        todo = stored(sizes.withColumn("_limit", F.least(F.coalesce(F.col("_cap") * 2, "_all"), "_all")))
        found, asked = None, None
        while True:
            some = todo.where("_limit < _all").select("run_id", "_limit")
            first = first_n(links.join(some, "run_id"), ["run_id"], F.col("_limit"), ["discovery_ord"]).select(*links.columns)
            chunk = stored(links.join(todo.where("_limit >= _all").select("run_id"), "run_id", "left_semi").unionByName(first))
            keys = chunk.select("product_key").unionByName(alone).distinct()
            new = keys if asked is None else keys.join(asked, "product_key", "left_anti")
            facts = self._chunk(new)
            found = facts if found is None else found.unionByName(facts)
            asked = stored(keys if asked is None else asked.unionByName(new))
            got = settle(linked_products(chunk, found)).where("outcome = 'exported'").groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
            short = todo.where("_limit < _all").join(got, "run_id", "left").where(F.coalesce("_n", F.lit(0)) < F.col("_cap"))
            todo = stored(short.select("run_id", "_all", "_cap", F.least(F.col("_limit") * 4, "_all").alias("_limit")))
            if todo.isEmpty():
                return found

    def _chunk(self, keys: DataFrame) -> DataFrame:
        """Product fields of the captures of some keys."""
        keys = stored(keys)
        wanted = self.index.join(keys, "product_key", "left_semi")
        return stored(_by_product(page_facts(self._wanted(wanted), self.config)).join(keys, "product_key", "left_semi"))


def crawl_run(
    runs: DataFrame,
    pages: DataFrame | None,
    config: JobConfig,
    processed: DataFrame | None = None,
    caps: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> RunResult:
    """Generic crawl of ``(run_id, seed_url)``: shapes, samples, pagination, products.

    The pattern comes from the seed page's links alone and then filters the
    links of every listing page the walk reaches.  With known products or caps captures are
    parsed as they are asked for: seeds, samples, pages that may list products, and then the
    captures of links to do, for runs with a cap in growing pieces until it is met; otherwise
    all captures of the runs' hosts are parsed at once.  ``facts`` takes a stored
    ``page_facts`` table in place of ``pages``.
    """
    runs = runs.select("run_id", canonical_url(F.col("seed_url")).alias("seed_url"))
    if facts is None and processed is None and caps is None:  # every capture of its hosts is wanted
        facts = stored(page_facts(captures_of_hosts(pages, runs), config))
    known_facts = _Captures(pages, runs, config) if facts is None else _Stored(facts)
    seeds = known_facts.seeds(runs)
    samples = _samples(seeds)
    patterns = cut_lineage(C.decide_patterns(C.verify_clusters(samples, known_facts.verdicts(samples))))

    # a run without a pattern walks nowhere
    walking = runs.join(patterns.where("template is not null").select("run_id", "template"), "run_id")
    walked, listing = known_facts.walk(walking, config.max_listing_pages)
    on_pages = walked.join(listing.select("page_key", "links"), "page_key").select(
        "run_id", "page_pos", F.explode("links").alias("url")
    )
    linked = C.product_links(on_pages, patterns).select(
        "run_id", "url", F.struct("page_pos", "url").alias("discovery_ord")
    )
    links, known = _first_links(linked), None
    if processed is not None:
        links, known = split_processed(cut_lineage(links), processed)
    by_product = known_facts.products(links, runs, caps)
    rows = linked_products(links, by_product)
    single, lost = _single_pages(seeds, by_product)
    settled, extra = _settled(rows.unionByName(single), caps, known)
    counters = run_counters(settled, *extra)
    linked_seeds = seeds.where(F.size("links") > 0).select("run_id")
    unmatched = linked_seeds.join(patterns.where("template is not null"), "run_id", "left_anti")
    notes = [patterns, lost, unmatched.withColumn("warning", F.lit(NO_PATTERN))]
    if config.max_listing_pages:
        notes.append(P.walk_warnings(walked, config.max_listing_pages))
    patterns = patterns.unionByName(single.select(
        "run_id", F.lit(SINGLE_PAGE).alias("template"), F.lit(None).cast("string").alias("warning")
    ))
    return RunResult(settled, counters, run_warnings(settled, counters, *notes), patterns)


def _single_pages(seeds: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds without any link are the product themselves: (rows, warnings).

    They are neither sampled nor skipped on resume, and one that is no product
    is a warning rather than a failed row.
    """
    alone = seeds.where(F.size("links") == 0).select(
        "run_id", F.col("seed_url").alias("url"), product_key(F.col("seed_url")).alias("product_key"),
        F.struct(F.lit(0).alias("page_pos"), F.col("seed_url").alias("url")).alias("discovery_ord"),
    )
    rows = linked_products(alone, facts)
    lost = rows.where("not usable").select("run_id", F.lit(NO_PRODUCT).alias("warning"))
    return rows.where("usable"), lost


def sitemap_run(
    runs: DataFrame,
    robots: DataFrame,
    sitemaps: DataFrame,
    pages: DataFrame | None,
    config: JobConfig,
    processed: DataFrame | None = None,
    caps: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> RunResult:
    """Products of the site's own sitemap; shape clustering where that fails.

    ``patterns`` tells per run which way it went.
    """
    facts = stored(page_facts(captures_of_hosts(readable(pages), runs), config)) if facts is None else facts
    by_product = stored(_by_product(facts))
    parsed = cut_lineage(M.parse_sitemaps(sitemaps))
    visited = M.walk_sitemaps(M.sitemap_roots(runs, robots), parsed, config.max_sitemap_docs)
    urls = cut_lineage(M.sitemap_product_urls(visited, parsed, runs, config.max_sitemap_urls))
    checks = cut_lineage(M.confirm_sitemaps(urls, by_product))
    good = checks.where("confirmed").select("run_id")
    described = M.sitemap_sources(urls, visited, parsed).join(good, "run_id", "left_semi")

    links = _first_links(
        urls.join(good, "run_id", "left_semi").select(
            "run_id", canonical_url(F.col("url")).alias("url"), F.struct("rank", "pos").alias("discovery_ord")
        )
    )
    known = None
    if processed is not None:
        links, known = split_processed(links, processed)
    direct, extra = _settled(linked_products(links, by_product), caps, known)
    direct_counters = run_counters(direct, *extra)

    others = runs.join(good, "run_id", "left_anti")
    crawl = crawl_run(others, None, config, processed, caps, facts)
    text_ord = F.format_string("%08d-%s", "discovery_ord.page_pos", "discovery_ord.url")
    place_ord = F.format_string("%08d-%08d", "discovery_ord.rank", "discovery_ord.pos")
    settled = direct.withColumn("discovery_ord", place_ord).unionByName(
        crawl.settled.withColumn("discovery_ord", text_ord)
    )
    patterns = described.select(
        "run_id", F.lit("sitemap").alias("source"), F.col("description").alias("template")
    ).unionByName(crawl.patterns.select("run_id", F.lit("generic").alias("source"), "template"))
    capped = [M.cap_warnings(rows, cap, what) for rows, cap, what in (
        (visited, config.max_sitemap_docs, "documents"), (urls, config.max_sitemap_urls, "addresses")) if cap]
    warnings = run_warnings(direct, direct_counters, checks, *capped).unionByName(crawl.warnings)
    return RunResult(settled, direct_counters.unionByName(crawl.counters), warnings, patterns)
