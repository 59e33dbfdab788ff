"""From run requests to the runs that may start, each with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.config import JobConfig
from shelfspark.functions.urls import canonical_url, product_key
from shelfspark.operators.reports import run_status
from shelfspark.operators.robots import robots_gate, robots_rules
from shelfspark.operators.routing import route
from shelfspark.sources.captures import readable, run_requests


def admit_runs(
    requests: DataFrame, robots: DataFrame, adapters: DataFrame, pages: DataFrame, config: JobConfig
) -> DataFrame:
    """Requests with ``status``, ``error``, ``adapter`` and ``source``.

    Runs with status ``done`` may go on: split them by ``source`` and hand them
    to the feed, sitemap or crawl plan.
    """
    runs = run_requests(requests)
    gate = robots_gate(runs.select("run_id", "url"), robots_rules(robots, config.user_agent))
    captured = readable(pages).select(product_key(canonical_url(F.col("url"))).alias("_key")).distinct()
    seeds = runs.select("run_id", product_key(canonical_url(F.col("url"))).alias("_key")).join(captured, "_key", "left_semi")
    return route(run_status(runs, gate, seeds), adapters)
