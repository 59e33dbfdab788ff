"""Run counters, warnings, status and the job record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("discovered", "exported", "skipped", "duplicates", "failed", "invalid")

NO_PRODUCTS = "The run ended without a product."
ROBOTS_SKIPPED = "robots.txt was not asked, as requested."
SEED_MISSING = "The seed page was not captured: the site may refuse robots, or the address is wrong."


def run_counters(settled: DataFrame, *extra: DataFrame) -> DataFrame:
    """One row per run, one pass over the rows.

    ``extra`` are per-run tables with ``skipped`` and/or ``failed`` counts of
    work that never became a row.
    """
    outcome = F.col("outcome")

    def count(*names: str) -> Column:
        return F.count_if(outcome.isin(*names))
    rows = settled.groupBy("run_id").agg(
        count("exported", "duplicate", "invalid").alias("discovered"),
        count("exported").alias("exported"),
        F.lit(0).cast("bigint").alias("skipped"),
        count("duplicate").alias("duplicates"),
        count("failed").alias("failed"),
        count("invalid").alias("invalid"),
    )
    parts = [rows] + [
        e.select("run_id", *[
            (F.col(c) if c in e.columns else F.lit(0)).cast("bigint").alias(c) for c in COUNTERS
        ]) for e in extra
    ]
    together = reduce(DataFrame.unionByName, parts)
    return together.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def run_warnings(settled: DataFrame, counters: DataFrame, *sources: DataFrame) -> DataFrame:
    """``(run_id, warning)`` rows: of the sources, the validator and empty runs.

    Rows, not one list per run: a run may have as many warnings as products.
    """
    checked = settled.where(F.col("outcome").isin("exported", "duplicate", "invalid")).select(
        "run_id", F.explode("warnings").alias("warning")
    )
    given = [s.where("warning is not null").select("run_id", "warning") for s in sources]
    noted = reduce(DataFrame.unionByName, [checked, *given])
    silent = counters.where("exported = 0").select("run_id").join(
        noted.select("run_id").distinct(), "run_id", "left_anti"
    )
    return noted.unionByName(silent.withColumn("warning", F.lit(NO_PRODUCTS)))


def run_status(runs: DataFrame, gate: DataFrame, seeds: DataFrame) -> DataFrame:
    """``blocked`` by robots, ``error`` without a seed page or valid address, else ``done``.

    ``gate`` has ``(run_id, allowed, reason)``; ``seeds`` the run ids whose seed
    page was captured.
    """
    joined = runs.join(gate.select("run_id", "allowed", "reason"), "run_id", "left").join(
        seeds.select("run_id", F.lit(True).alias("_seed")).distinct(), "run_id", "left"
    )
    skip = F.coalesce("ignore_robots", F.lit(False))
    blocked = ~skip & ~F.coalesce("allowed", F.lit(True))
    invalid = ~F.col("valid")
    missing = F.col("_seed").isNull()
    return joined.select(
        *runs.columns,
        F.when(invalid, "error").when(blocked, "blocked").when(missing, "error").otherwise("done").alias("status"),
        F.when(invalid, F.col("refusal") if "refusal" in runs.columns else F.lit("invalid request"))
        .when(blocked, F.col("reason")).when(missing, F.lit(SEED_MISSING)).alias("error"),
        F.when(skip, F.lit(ROBOTS_SKIPPED)).alias("warning"),
    )


def run_order(records: DataFrame) -> list:
    """Newest run first, ties by run."""
    return [F.desc("created_at"), "run_id"]


def job_records(status: DataFrame, counters: DataFrame) -> DataFrame:
    """Status, counters and whether there is a CSV, newest run first."""
    joined = status.join(counters, "run_id", "left")
    for name in COUNTERS:
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    joined = joined.withColumn("has_csv", (F.col("status") == "done") & (F.col("exported") > 0))
    return joined.orderBy(*run_order(joined)) if "created_at" in joined.columns else joined
