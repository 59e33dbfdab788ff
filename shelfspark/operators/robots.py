"""May a URL be fetched?  Robots files are read once per origin."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.urls import is_http, origin_of
from shelfspark.operators.ranking import first_per_key

_RULES = pa.list_(pa.struct([("allow", pa.bool_()), ("prefix", pa.string())]))
_SCHEMA = "origin string, status int, rules array<struct<allow:boolean,prefix:string>>"


def _rules_for(body: str | None, agent: str) -> list[dict]:
    """The rules of the group that applies to the agent, in file order."""
    parser = RobotFileParser()
    parser.parse((body or "").splitlines())
    groups = [*parser.entries, *filter(None, [parser.default_entry])]
    group = next((g for g in groups if g.applies_to(agent)), None)
    return [
        {"allow": rule.allowance, "prefix": unquote(rule.path)}
        for rule in (group.rulelines if group else [])
    ]


def capture_order(robots: DataFrame) -> list:
    """Which capture of a file counts: the one answered, by ``captured_at`` or ``page_id`` if there is one, then by text."""
    named = [c for c in ("captured_at", "page_id") if c in robots.columns]
    return [F.coalesce("status", F.lit(200)) >= 400, *named, "status", "body"]


def robots_rules(robots: DataFrame, user_agent: str) -> DataFrame:
    """``(origin, status, rules)``, one row per origin however often it was captured; one Arrow pass."""
    robots = first_per_key(robots, ["origin"], *capture_order(robots))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [_rules_for(body, user_agent) for body in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("origin"), batch.column("status"), pa.array(rules, _RULES)],
                names=["origin", "status", "rules"],
            )
    return robots.select("origin", F.col("status").cast("int"), "body").mapInArrow(run, _SCHEMA)


def robots_gate(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed`` and ``reason``: the first rule whose prefix fits decides.

    A missing file or a status of 400 and above allows; a URL that is not
    absolute http(s) is refused.
    """
    url = F.col("url")
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    target = F.regexp_replace(decoded, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    target = F.when(target == "", F.lit("/")).otherwise(target)
    joined = urls.withColumn("_origin", origin_of(url)).withColumn("_target", target).join(
        rules.select(F.col("origin").alias("_origin"), "status", "rules"), "_origin", "left"
    )
    fitting = F.filter("rules", lambda r: F.startswith(F.col("_target"), r["prefix"]))
    verdict = F.coalesce(F.get(fitting, F.lit(0))["allow"], F.lit(True))
    missing, bad = F.col("status").isNull(), F.col("status") >= 400
    return (
        joined.withColumn("_http", is_http(url))
        .withColumn("allowed", F.col("_http") & (missing | bad | verdict))
        .withColumn("reason", F.when(~F.col("_http"), F.concat(F.lit("refused, no http(s) address: "), url))
            .when(missing, F.lit("allowed: no robots.txt was captured"))
            .when(bad, F.format_string("allowed: robots.txt answered HTTP %d", "status"))
            .when(F.col("allowed"), F.lit("allowed: robots.txt has no rule against it"))
            .otherwise(F.concat(
                F.col("_origin"), F.lit("/robots.txt forbids "), url
            )))
        .drop("_origin", "_target", "_http", "status", "rules")
    )
