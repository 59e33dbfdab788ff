"""Category columns of feed products, read off their detail pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import variants as V
from shelfspark.operators.membership import keep_members
from shelfspark.operators.parse import embedded_details
from shelfspark.operators.ranking import first_per_key
from shelfspark.operators.taxonomy import with_labels
from shelfspark.sources.captures import readable


def detail_ids(details: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(product_key, level2_id, level3_id)`` of detail pages that can be read.

    Pages shrink to two numbers before anything is joined or shuffled. With ``wanted``
    (a table with ``product_key``) only bodies of its keys, and a few others, are searched.
    """
    pages = readable(details)
    if wanted is not None:
        pages = keep_members(pages, wanted, "product_key")
    found = embedded_details(pages.select("product_key", "page_id", "html")).where(F.col("detail").isNotNull())
    ids = found.select("product_key", "page_id", F.try_parse_json("detail").alias("d")).select(
        "product_key", "page_id",
        V.int_at(F.col("d"), "$.level2CatId").alias("level2_id"),
        V.int_at(F.col("d"), "$.level3CatId").alias("level3_id"),
    )
    return first_per_key(ids, ["product_key"], "page_id").drop("page_id").withColumn("readable", F.lit(True))


def enrich(products: DataFrame, ids: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Fills category and subcategory; products without a detail page stay as they are.

    Adds ``enriched``: False marks a miss.
    """
    joined = products.join(ids, "product_key", "left").withColumn(
        "enriched", F.coalesce("readable", F.lit(False))
    ).drop("readable")
    labelled = with_labels(joined, taxonomy, "level2_id", "level3_id", "_category", "_subcategory")
    for name in ("category", "subcategory"):
        labelled = labelled.withColumn(
            name, F.when(F.col("enriched"), F.col(f"_{name}")).otherwise(F.col(name))
        ).drop(f"_{name}")
    return labelled


def enrichment_misses(enriched: DataFrame) -> DataFrame:
    """``(run_id, products, misses, warning)``."""
    counted = enriched.groupBy("run_id").agg(
        F.count("*").alias("products"), F.count_if(~F.col("enriched")).alias("misses")
    )
    return counted.withColumn("warning", F.when(F.col("misses") > 0, F.format_string(
        "%d detail page(s) gave no category; their rows have none.", "misses"
    )))
