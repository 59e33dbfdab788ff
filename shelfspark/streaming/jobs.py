"""Products from captures as they arrive, in two streams.

The first parses captures and writes narrow product rows; extraction is stateless and the
same as in batch. The second settles the rows. Which keys are new it learns from Spark's keyed
state (a streaming de-duplication over the rows' keys), so a micro-batch costs what
arrives in it, however long the history is; nothing written before is read again.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from shelfspark.config import JobConfig
from shelfspark.functions.urls import bare_url, canonical_url
from shelfspark.operators.extract import GENERIC_CHAIN, build_products, extract_fields
from shelfspark.operators.parse import parse_pages
from shelfspark.operators.quality import settle, validate
from shelfspark.operators.signals import with_signals
from shelfspark.sources.captures import has_files, readable

_STATE = "spark.sql.streaming.stateStore.providerClass"
_IN_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
PAGES_SCHEMA = "page_id bigint, url string, html string, status int"


def captured_pages(spark: SparkSession, path: str, schema: str = PAGES_SCHEMA, files: int = 0, tasks: int = 0) -> DataFrame:
    """New capture files of a folder, at most ``files`` per micro-batch.

    A micro-batch is dealt to ``tasks`` tasks (0: as many as run at a time), since a file of one row group is read by one.
    """
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).repartition(tasks or spark.sparkContext.defaultParallelism, "page_id", "url")


def page_products(pages: DataFrame, run_id: str, config: JobConfig) -> DataFrame:
    """Batch or stream: one product row per readable capture."""
    parsed = parse_pages(
        readable(pages).select("page_id", bare_url(canonical_url(F.col("url"))).alias("url"), "html")
    )
    extracted = extract_fields(with_signals(parsed), GENERIC_CHAIN, config)
    rows = build_products(extracted, keep=("page_id",))
    return rows.withColumn("run_id", F.lit(run_id)).withColumnRenamed("page_id", "discovery_ord")


@dataclass
class ProductStream:
    """The two running queries and what they write."""

    parse: StreamingQuery
    settle: StreamingQuery
    out: str
    began: datetime

    def awaitTermination(self) -> None:  # noqa: N802 - Spark's name
        self.parse.awaitTermination()
        self.settle.awaitTermination()

    def stop(self) -> None:
        self.parse.stop()
        self.settle.stop()


def _row_stream(products: DataFrame, folder: str, checkpoint: str, once: bool) -> StreamingQuery:
    """Parsed rows with the time of their micro-batch, which repeats of the batch keep."""
    rows = products.observe(
        "progress", F.count(F.lit(1)).alias("pages"), F.count_if("usable").alias("products")
    ).withColumn("arrived", F.current_timestamp())
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_product_stream(
    products: DataFrame, out: str, checkpoint: str, *, once: bool = True
) -> ProductStream:
    """Settle rows as they arrive and write them under ``out``.

    The first valid product of a key, by arrival and then ``discovery_ord``, is exported; later
    ones are duplicates, also after a restart: the keys are in the state store below
    ``checkpoint``. ``out`` is partitioned by batch id and a batch overwrites its own folder,
    so a batch repeated after a crash ends with the same rows. Failed and invalid pages
    are counted but not remembered, so a later capture is tried again. ``progress`` beside ``out``
    has a row per batch.
    """
    spark = products.sparkSession
    began = spark.sql("SELECT current_timestamp()").first()[0]
    if spark.conf.get(_STATE, None) in (None, _IN_MEMORY):
        spark.conf.set(_STATE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    folder = f"{checkpoint}/rows"
    parse = _row_stream(products, folder, f"{checkpoint}/parse", once)
    if once:  # all that has arrived is parsed before it is settled
        parse.awaitTermination()
    schema = T.StructType([*products.schema.fields, T.StructField("arrived", T.TimestampType())])
    rows = spark.readStream.schema(schema).parquet(folder)
    good = validate(rows).where("usable and valid").select("run_id", "product_key")
    fresh = good.dropDuplicates(["run_id", "product_key"]).withColumn("_fresh", F.lit(True))
    both = rows.withColumn("_fresh", F.lit(False)).unionByName(fresh, allowMissingColumns=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        rows = batch.where("NOT _fresh").drop("_fresh").withColumn("_ord", F.col("discovery_ord"))
        settled = settle(rows.withColumn("discovery_ord", F.struct("arrived", "_ord")))
        new = batch.where("_fresh").select("run_id", "product_key", "_fresh")
        settled = settled.join(new, ["run_id", "product_key"], "left").withColumn(
            "outcome", F.when(F.col("_fresh").isNull() & (F.col("outcome") == "exported"), "duplicate").otherwise(F.col("outcome")),
        ).withColumn("discovery_ord", F.col("_ord"))
        (
            settled.drop("errors", "warnings", "usable", "valid", "_fresh", "_ord", "arrived").withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(out)
        )
        seen = batch.where("NOT _fresh").groupBy("arrived").agg(F.count(F.lit(1)).alias("pages"), F.count_if("usable").alias("products"))
        (
            seen.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}-progress")
        )
        batch.unpersist()

    writer = both.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/settle")
    return ProductStream(parse, (writer.trigger(availableNow=True) if once else writer).start(), out, began)


def arrival_progress(spark: SparkSession, out: str) -> DataFrame:
    """``(arrived, pages, products)``: captures seen and products extracted of every micro-batch, restarts included."""
    schema = "arrived timestamp, pages bigint, products bigint, batch_id bigint"
    rows = spark.read.schema(schema).parquet(f"{out}-progress") if has_files(spark, f"{out}-progress") else spark.createDataFrame([], schema)
    return rows.groupBy("arrived").agg(F.sum("pages").alias("pages"), F.sum("products").alias("products"))


def progress_totals(stream: ProductStream) -> dict[str, int]:
    """Pages seen and products extracted since ``start_product_stream`` began a run."""
    rows = arrival_progress(SparkSession.active(), stream.out)
    return rows.where(F.col("arrived") >= F.lit(stream.began)).agg(
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("products"), F.lit(0)).alias("products")).first().asDict()


class ProgressCounter(StreamingQueryListener):
    """Live totals of pages seen and products extracted: add it to ``spark.streams`` before a start."""

    def __init__(self) -> None:
        self.pages = 0
        self.products = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get("progress")
        if seen is not None:
            self.pages += seen["pages"]
            self.products += seen["products"]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
