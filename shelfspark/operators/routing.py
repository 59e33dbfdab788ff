"""Which source handles a URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.config import EXPLICIT_SOURCES
from shelfspark.functions.urls import domains_of, host_of


def route(runs: DataFrame, adapters: DataFrame) -> DataFrame:
    """Adds ``adapter`` (registered domain) and ``source`` to rows with ``url``.

    Hosts are routed once each, not once per URL.  A ``requested`` column other
    than ``auto`` wins over the registry; an unknown name gives source NULL and
    ``route_error``.
    """
    rows = runs.withColumn("_host", host_of(F.col("url")))
    hosts = rows.select("_host").distinct().select(
        "_host", F.posexplode(domains_of(F.col("_host"))).alias("_pos", "domain")
    )
    found = hosts.join(adapters, "domain").groupBy("_host").agg(
        F.min_by("domain", "_pos").alias("adapter"), F.min_by("source", "_pos").alias("_source")
    )
    routed = rows.join(found, "_host", "left").drop("_host")
    automatic = F.coalesce("_source", F.lit("generic"))
    if "requested" not in runs.columns:
        return routed.withColumn("source", automatic).drop("_source")
    asked = F.coalesce("requested", F.lit("auto"))
    known = asked.isin("auto", *EXPLICIT_SOURCES)
    return (
        routed.withColumn("source", F.when(asked == "auto", automatic).when(known, asked))
        .withColumn("route_error", F.when(~known, F.format_string("Unknown source '%s'", asked)))
        .drop("_source")
    )
