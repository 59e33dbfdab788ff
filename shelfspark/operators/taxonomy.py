"""Category ids to labels (a dimension join) and the ids nobody has named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.config import TAXONOMY_LEVEL2, TAXONOMY_LEVEL3, UNKNOWN_CATEGORY_PREFIX
from shelfspark.session import local_rows

SCHEMA = "level string, id bigint, name string"


def builtin_taxonomy(spark: SparkSession) -> DataFrame:
    rows = [("level2", i, n) for i, n in TAXONOMY_LEVEL2.items()]
    rows += [("level3", i, n) for i, n in TAXONOMY_LEVEL3.items()]
    return local_rows(spark, rows, SCHEMA)


def override_rows(documents: DataFrame) -> DataFrame:
    """Rows of override documents (column ``body``), ``{"level2": {"999": "Footwear"}}``.

    Keys that are not whole numbers are dropped; a document that is not JSON
    yields no rows, which leaves the built-in names in force.
    """
    doc = documents.select(F.try_parse_json("body").alias("doc"))
    levels = [
        doc.select(
            F.lit(level).alias("level"),
            F.explode(F.map_entries(
                F.try_variant_get("doc", f"$.{level}", "map<string,string>")
            )).alias("e"),
        )
        for level in ("level2", "level3")
    ]
    return (
        levels[0].unionByName(levels[1])
        .select("level", F.trim("e.key").try_cast("bigint").alias("id"), F.col("e.value").alias("name"))
        .where(F.col("id").isNotNull())
    )


def merged_taxonomy(base: DataFrame, override: DataFrame) -> DataFrame:
    """Override wins per (level, id); of several overrides of an id, the greatest name."""
    ranked = base.withColumn("_p", F.lit(0)).unionByName(override.withColumn("_p", F.lit(1)))
    return ranked.groupBy("level", "id").agg(F.max_by("name", F.struct("_p", "name")).alias("name"))


def _names(taxonomy: DataFrame) -> DataFrame:
    """One name per (level, id): of repeated ids the smallest."""
    return taxonomy.groupBy("level", "id").agg(F.min("name").alias("name"))


def with_labels(
    df: DataFrame, taxonomy: DataFrame, level2: str, level3: str,
    category: str = "category", subcategory: str = "subcategory",
) -> DataFrame:
    """Known id: its name; unknown id: ``cat:<id>``; no id: NULL.

    An id that the taxonomy repeats gets the smallest of its names; no row of ``df`` is repeated.

    Plain left joins: Spark broadcasts the dimension only while its size is
    under the session's threshold and shuffles otherwise.
    """
    taxonomy = _names(taxonomy)
    for level, id_col, out in (("level2", level2, category), ("level3", level3, subcategory)):
        names = taxonomy.where(F.col("level") == level).select(
            F.col("id").alias("_id"), F.col("name").alias("_name")
        )
        df = (
            df.join(names, F.col(id_col) == F.col("_id"), "left")
            .withColumn(out, _label(F.col(id_col), F.col("_name")))
            .drop("_id", "_name")
        )
    return df


def _label(cat_id: Column, name: Column) -> Column:
    unknown = F.concat(F.lit(UNKNOWN_CATEGORY_PREFIX), cat_id.cast("string"))
    return F.when(cat_id.isNotNull(), F.coalesce(name, unknown))


def unmapped(df: DataFrame, taxonomy: DataFrame, level2: str, level3: str) -> DataFrame:
    """Distinct (level, id) pairs without a name, with the report's sentence."""
    # an array of two structs is exploded, so the input is read once
    ids = df.select(F.explode(F.array(
        F.struct(F.lit("level2").alias("level"), F.col(level2).alias("id")),
        F.struct(F.lit("level3").alias("level"), F.col(level3).alias("id")),
    )).alias("p")).select("p.level", "p.id").where(F.col("id").isNotNull()).distinct()
    return ids.join(taxonomy, ["level", "id"], "left_anti").withColumn(
        "warning",
        F.format_string(
            "No name for %s category %d; exported as cat:%d.",
            "level", "id", "id",
        ),
    )
