"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.config import JobConfig
from shelfspark.queries.registry import money, query
from shelfspark.rendering import storefront as R
from shelfspark.session import ensure_checkpoint_dir
from shelfspark.streaming.jobs import arrival_progress, captured_pages, page_products, start_product_stream


def _drain(spark, arrivals, progress=False):
    """Land captures in a folder and drain them through the stream, which starts anew for each item.

    An item is a table, or a list of tables that land one after the other, a file each, and are read a file at a time.
    """
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for item in arrivals:
        single = isinstance(item, list)
        for batch in item if single else [item]:
            batch = batch if "status" in batch.columns else batch.withColumn("status", F.lit(200))
            batch = batch.select("page_id", "url", "html", "status")
            (batch.coalesce(1) if single else batch).write.mode("append").parquet(f"{root}/pages")
        rows = page_products(captured_pages(spark, f"{root}/pages", files=int(single)), "stream", JobConfig())
        stream = start_product_stream(rows, f"{root}/products", f"{root}/checkpoint")
        stream.awaitTermination()
    return arrival_progress(spark, f"{root}/products") if progress else spark.read.parquet(f"{root}/products")


@query("stream_products", """
SELECT p_partkey AS k, p_name AS name, 'exported' AS outcome, CAST(0 AS BIGINT) AS batch_id FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_name, 'exported', 1 FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT p_partkey, p_name, 'duplicate', 1 FROM part WHERE p_partkey % 10 = 0""")
def stream_products(spark, sf_dir):
    """ST1, ST2, ST3: two arrivals, the second repeats pages of the first."""
    pages = R.product_pages(spark, sf_dir, "jsonld")
    out = _drain(spark, (pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1 or page_id % 10 = 0")))
    return out.select(F.col("discovery_ord").alias("k"), "name", "outcome", F.col("batch_id").cast("bigint").alias("batch_id"))


@query("stream_retries", """
SELECT p_partkey AS k, 'failed' AS outcome, CAST(0 AS BIGINT) AS batch_id, CAST(NULL AS DOUBLE) AS asp FROM part
UNION ALL SELECT p_partkey, 'exported', 1, CAST((CAST(round(p_retailprice * 100) AS BIGINT) + 100000 * (p_partkey % 3) - CASE WHEN p_partkey % 2 = 0 THEN 100 * p_size ELSE 0 END) / 100.0 AS DOUBLE) FROM part""")
def stream_retries(spark, sf_dir):
    """ST3: a page that failed is extracted when a better capture arrives."""
    good = R.product_pages(spark, sf_dir, "jsonld")
    bad = good.withColumn("html", F.lit("<html><body>later</body></html>"))
    out = _drain(spark, (bad, good))
    return out.select(F.col("discovery_ord").alias("k"), "outcome", F.col("batch_id").cast("bigint").alias("batch_id"), money("asp").alias("asp"))


@query("stream_progress", """
SELECT b AS batch, CAST(count(*) FILTER (b < 2 OR p_partkey % 4 <> 1) AS BIGINT) AS pages, CAST(count(*) FILTER (b < 2 OR p_partkey % 4 <> 1) AS BIGINT) AS products
FROM part, LATERAL (SELECT unnest([0, 1, 2]) AS b) WHERE p_partkey % 3 = b GROUP BY 1""")
def stream_progress(spark, sf_dir):
    """ST4 and ST1: live counters of three arrivals; captures that were refused are not seen."""
    pages = R.product_pages(spark, sf_dir, "jsonld")
    last = pages.where("page_id % 3 = 2").withColumn("status", F.expr("if(page_id % 4 = 1, 503, 200)"))
    arrivals = _drain(spark, (pages.where("page_id % 3 = 0"), pages.where("page_id % 3 = 1"), last), progress=True)
    nth = (F.row_number().over(Window.orderBy("arrived")) - 1).alias("batch")  # one row per micro-batch
    return arrivals.select(nth, "pages", "products")


@query("stream_first_wins", """
WITH a AS (SELECT p_partkey AS k, p_name AS name, t, (20 - t) * 10000000 + p_partkey AS ord FROM part, LATERAL (SELECT unnest(range(0, 20)) AS t)
  WHERE p_partkey % 20 = t OR (p_partkey % 7 = 0 AND (p_partkey + t) % 5 = 0))
SELECT k, CAST(t AS BIGINT) AS arrival, name, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY t) = 1 THEN 'exported' ELSE 'duplicate' END AS outcome FROM a""")
def stream_first_wins(spark, sf_dir):
    """ST2 and ST3 over twenty arrivals, a file each, with a restart after ten: the first to arrive wins, whatever its number."""
    pages = R.product_pages(spark, sf_dir, "jsonld")
    arrivals = [
        pages.where(f"page_id % 20 = {t} or (page_id % 7 = 0 and (page_id + {t}) % 5 = 0)").withColumn("page_id", F.expr(f"{20 - t} * 10000000L + page_id"))
        for t in range(20)
    ]
    out = _drain(spark, (arrivals[:10], arrivals[10:]))
    t = F.lit(20) - F.floor(F.col("discovery_ord") / 10000000)
    return out.select((F.col("discovery_ord") % 10000000).alias("k"), t.cast("bigint").alias("arrival"), "name", "outcome")
