"""Writing products, processed keys and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.config import PRODUCT_FIELDS
from shelfspark.functions.money import money_text
from shelfspark.sources.captures import has_files, read_processed


def csv_row(products: DataFrame, *keep: str) -> DataFrame:
    """The seven text columns of an exported row, in their fixed order, behind those to keep."""
    def cell(name: str) -> Column:
        if name in ("mrp", "asp"):
            return money_text(F.col(name))
        return F.coalesce(name, F.lit(""))
    return products.select(*keep, *[cell(n).alias(n) for n in PRODUCT_FIELDS])


def write_product_csv(products: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, minimal quoting, doubled quotes, '' for NULL.

    Every task writes its own file in discovery order when the rows carry one;
    the commit protocol makes the folder appear as a whole.
    """
    rows = products.sortWithinPartitions("discovery_ord") if "discovery_ord" in products.columns else products
    csv_row(rows).write.mode(mode).csv(
        path, header=True, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_run_csv(products: DataFrame, path: str) -> None:
    """One CSV per run, ``run_id=…``: its part files, joined in name order, are the file.

    The header stands once, at the top of a run's first part, and rows follow in discovery
    order across the parts. Runs are dealt out by ranges of (run, place), so a large run is
    written by many tasks.
    """
    kind = products.schema["discovery_ord"].dataType
    rows = csv_row(products, "run_id", "discovery_ord")
    top = products.select("run_id").distinct().select(
        "run_id", F.lit(None).cast(kind).alias("discovery_ord"), *[F.lit(n).alias(n) for n in PRODUCT_FIELDS])
    order = [F.col("run_id"), F.col("discovery_ord").asc_nulls_first()]
    (
        top.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("discovery_ord")
        .write.mode("overwrite").partitionBy("run_id").csv(
            path, header=False, quote='"', escape='"', emptyValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    )


def write_processed(keys: DataFrame, path: str) -> None:
    """Add keys to the remembered ones, one folder per run."""
    keys.select("run_id", "product_key").write.mode("append").partitionBy("run_id").parquet(path)


def clear_processed(keys: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Replace the keys of the given runs and leave all other runs alone.

    ``runs`` (column ``run_id``) are emptied where ``keys`` has none of theirs; without it
    only runs that have keys are touched.
    """
    if runs is not None:
        _drop_runs(runs.join(keys, "run_id", "left_anti"), path)
    (
        keys.select("run_id", "product_key").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    )


def _drop_runs(runs: DataFrame, path: str) -> None:
    """Delete the folders of runs; the folders are read off the files, the driver gets one name per run."""
    spark = runs.sparkSession
    if not has_files(spark, path):
        return
    there = read_processed(spark, path).select("run_id", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"))
    for row in there.join(runs.select("run_id"), "run_id", "left_semi").select("folder").distinct().toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row["folder"]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_report(report: DataFrame, path: str) -> None:
    """Counters or job records; a table of one row per run."""
    report.write.mode("append").parquet(path)
