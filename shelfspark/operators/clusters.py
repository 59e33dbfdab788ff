"""Which links of a site are products: cluster by URL shape, then check samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.config import (
    MAX_CANDIDATE_CLUSTERS,
    MIN_CLUSTER_SIZE,
    SAMPLE_SIZE,
    JobConfig,
)
from shelfspark.functions.urls import bare_url, bucket_of, canonical_url, matches_template, product_key, segments_of
from shelfspark.operators.extract import GENERIC_CHAIN, extract_fields, looks_like_product
from shelfspark.operators.membership import keep_members
from shelfspark.operators.parse import parse_pages
from shelfspark.operators.ranking import first_per_key
from shelfspark.operators.signals import with_signals
from shelfspark.sources.captures import capture_index, readable

BUCKET = ["run_id", "depth", "first_segment"]


def shaped_links(candidates: DataFrame) -> DataFrame:
    """``(run_id, depth, first_segment, url, segments)`` of clusterable links.

    ``candidates`` holds distinct ``(run_id, url)`` and, if there is one, the
    ``seed_url`` that is no candidate itself.
    """
    links = candidates
    if "seed_url" in links.columns:
        links = links.where(
            F.rtrim("url", F.lit("/")) != F.rtrim("seed_url", F.lit("/"))
        )
    return (
        links.select("run_id", "url", segments_of(F.col("url")).alias("segments"))
        .where(F.col("segments").isNotNull())
        .withColumn("_b", bucket_of(F.col("segments")))
        .select("run_id", "_b.depth", "_b.first_segment", "url", "segments")
    )


def url_buckets(links: DataFrame) -> DataFrame:
    """Size and first URL of every shape bucket (partial aggregation per task)."""
    return links.groupBy(*BUCKET).agg(F.count("*").alias("n_urls"), F.min("url").alias("first_url"))


def bucket_templates(links: DataFrame) -> DataFrame:
    """Buckets with ``/catalogue/*/index.html``: literal where all URLs agree.

    Agreement is min = max per position, so a bucket is never collected; only
    its few path positions are.  Every URL has every position of its bucket once,
    so the size and the first URL come from the same pass.
    """
    positions = links.select(*BUCKET, "url", F.posexplode("segments").alias("pos", "segment"))
    parts = positions.groupBy(*BUCKET, "pos").agg(
        F.min("segment").alias("lo"), F.max("segment").alias("hi"),
        F.count("*").alias("n"), F.min("url").alias("url"),
    )
    part = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("*"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return parts.groupBy(*BUCKET).agg(
        F.max("n").alias("n_urls"), F.min("url").alias("first_url"),
        F.concat(F.lit("/"), F.array_join(F.transform(ordered, lambda p: p["part"]), "/"))
        .alias("template"),
    )


def candidate_clusters(links: DataFrame) -> DataFrame:
    """The largest buckets of a run with rank and template, ties by first URL."""
    order = Window.partitionBy("run_id").orderBy(F.desc("n_urls"), "first_url")
    return (
        bucket_templates(links).where(F.col("n_urls") >= MIN_CLUSTER_SIZE)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= MAX_CANDIDATE_CLUSTERS)
    )


def cluster_samples(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """The first URLs of every candidate cluster."""
    order = Window.partitionBy(*BUCKET).orderBy("url")
    return (
        links.select(*BUCKET, "url")
        .withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= SAMPLE_SIZE).drop("_rn")
        .join(clusters.select(*BUCKET, "rank", "template", "n_urls"), BUCKET)
        .withColumn("product_key", product_key(F.col("url")))
    )


def product_verdicts(keys: DataFrame, pages: DataFrame, config: JobConfig) -> DataFrame:
    """``(product_key, hit)`` of the captured pages among ``keys``.

    Only captures of these keys are parsed; the rest of ``pages`` gives its address. What
    is ranked and joined is a verdict per capture.
    """
    keys = keys.select("product_key")
    wanted = capture_index(pages).join(keys, "product_key", "left_semi")
    url = canonical_url(F.col("url"))
    found = keep_members(readable(pages), wanted, "page_id").select("page_id", bare_url(url).alias("url"), product_key(url).alias("product_key"), "html")
    extracted = extract_fields(with_signals(parse_pages(found)), GENERIC_CHAIN, config)
    verdicts = extracted.select("product_key", "page_id", looks_like_product(F.col("fields"), F.col("is_product_page")).alias("hit"))
    return first_per_key(verdicts.join(keys, "product_key", "left_semi"), ["product_key"], "page_id").drop("page_id")


def verify_clusters(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Clusters with ``hits`` of ``sampled``; a page not captured is a miss.

    ``verdicts`` has ``(product_key, hit)``, from stored facts or, for the
    samples alone, from ``product_verdicts``.
    """
    return (
        samples.join(verdicts.select("product_key", "hit"), "product_key", "left")
        .groupBy(*BUCKET, "rank", "template", "n_urls")
        .agg(F.count("*").alias("sampled"), F.count_if("hit").alias("hits"))
        .withColumn("verified", F.col("hits") * 2 > F.col("sampled"))
    )


def decide_patterns(verified: DataFrame) -> DataFrame:
    """One row per run: the first verified template in rank order, or a warning.

    The collected list holds at most MAX_CANDIDATE_CLUSTERS entries.
    """
    tried = F.array_sort(F.collect_list(F.struct("rank", "template")))
    names = F.array_join(F.transform(tried, lambda t: t["template"]), ", ")
    decided = verified.groupBy("run_id").agg(
        F.min_by(
            F.when(F.col("verified"), F.col("template")), F.when(F.col("verified"), F.col("rank"))
        ).alias("template"),
        F.count("*").alias("_n"),
        names.alias("_names"),
    )
    return decided.select(
        "run_id", "template",
        F.when(F.col("template").isNull(), F.format_string(
            "Tried the %d largest shapes of links (%s); their samples held no products.", "_n", "_names"
        )).alias("warning"),
    )


def product_links(candidates: DataFrame, patterns: DataFrame) -> DataFrame:
    """Candidates that fit their run's template."""
    return (
        candidates.join(patterns.where("template is not null").select("run_id", "template"), "run_id")
        .where(matches_template(F.col("url"), F.col("template")))
        .drop("template")
    )
