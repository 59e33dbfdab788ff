"""Reading captured inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.config import DEFAULT_REQUESTED_PRODUCTS, MAX_REQUESTED_PRODUCTS, PRODUCT_FIELDS
from shelfspark.functions.text import strip
from shelfspark.functions.urls import bare_url, canonical_url, host_of, is_http, product_key
from shelfspark.operators.membership import keep_members
from shelfspark.operators.ranking import first_per_key


def read_pages(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """Page captures ``(page_id, url, html[, status])``.

    ``tasks`` deals the captures out anew, for a table of a few files that can't be split.
    """
    pages = spark.read.parquet(path)
    return pages.repartition(tasks) if tasks else pages


def captures_of_hosts(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Captures of the hosts that ``(run_id, seed_url)`` runs go to, and a few others; bodies stay where they are."""
    hosts = runs.select(host_of(canonical_url(F.col("seed_url"))).alias("_host"))
    return keep_members(pages.withColumn("_host", host_of(canonical_url(F.col("url")))), hosts, "_host").drop("_host")


def capture_index(pages: DataFrame) -> DataFrame:
    """``(page_id, url, product_key)`` of captures that may be readable; bodies are not read."""
    if "status" in pages.columns:
        pages = pages.where(F.coalesce("status", F.lit(200)) < 400)
    url = canonical_url(F.col("url"))
    return pages.select("page_id", url.alias("url"), product_key(url).alias("product_key"))


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw sitemap files of a folder as ``(url, status, body)``; the path is the url."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("url"), F.lit(200).alias("status"), F.col("content").alias("body"))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each: robots files or override documents."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("body")
    )


def readable(pages: DataFrame) -> DataFrame:
    """Captures that were answered: no body or status of 400 and above is a miss."""
    if "status" in pages.columns:
        pages = pages.where(F.coalesce("status", F.lit(200)) < 400)
    return pages.where(F.col("html").isNotNull())


def captures_for_keys(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """``(product_key, page_id, url, html)``: the first capture of every wanted key.

    Bodies are filtered where they are read; only those of wanted keys are ranked.
    """
    wanted = capture_index(pages).join(keys.select("product_key"), "product_key", "left_semi")
    url = canonical_url(F.col("url"))
    found = keep_members(readable(pages), wanted, "page_id").select("page_id", bare_url(url).alias("url"), "html", product_key(url).alias("product_key"))
    found = found.join(keys.select("product_key"), "product_key", "left_semi")
    return first_per_key(found, ["product_key"], "page_id")


def has_files(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and len(files.listStatus(folder)) > 0


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Remembered keys ``(run_id, product_key)``; run ids stay text, whatever they look like."""
    return spark.read.schema("product_key string, run_id string").parquet(path)


def processed_keys(processed: DataFrame | None, run_id: str | None = None) -> DataFrame | None:
    """Keys of earlier runs, or of one run."""
    if processed is None or run_id is None:
        return processed
    return processed.where(F.col("run_id") == run_id)


def run_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``valid`` and ``refusal``.

    An address must be absolute http(s), a product cap lie between 1 and the most a request
    may ask for; a request without a cap gets the default.
    """
    url, cap = strip(F.col("url")), F.coalesce("max_products", F.lit(DEFAULT_REQUESTED_PRODUCTS))
    refusal = F.when(~F.coalesce(is_http(url), F.lit(False)), F.lit("url is no absolute http(s) address")).when(
        ~cap.between(1, MAX_REQUESTED_PRODUCTS), F.lit(f"max_products lies outside 1 to {MAX_REQUESTED_PRODUCTS}"))
    return requests.withColumns({"url": url, "max_products": cap}).withColumn("refusal", refusal).withColumn("valid", F.col("refusal").isNull())


def read_run_csv(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, place`` (from 1, in file order) and the text columns of the CSVs of runs."""
    schema = ", ".join(f"{n} string" for n in (*PRODUCT_FIELDS, "run_id"))
    rows = spark.read.schema(schema).csv(
        path, header=False, multiLine=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at")).na.fill("", PRODUCT_FIELDS)
    lines = rows.where(~F.forall(F.array(*[F.col(n) == n for n in PRODUCT_FIELDS]), lambda same: same))
    numbered = lines.withColumn("_no", F.row_number().over(Window.partitionBy("run_id", "_file").orderBy("_at")))
    sizes = lines.groupBy("run_id", "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("run_id", "_file", (F.sum("_n").over(Window.partitionBy("run_id").orderBy("_file")) - F.col("_n")).alias("_before"))
    return numbered.join(before, ["run_id", "_file"]).select("run_id", (F.col("_before") + F.col("_no")).alias("place"), *PRODUCT_FIELDS)


def read_product_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported CSV as it was written: all columns text, no NULL."""
    return spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, escape='"', quote='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).na.fill("")
