"""Validation, identity, resume and the product cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.money import money_text
from shelfspark.functions.text import strip
from shelfspark.operators.ranking import first_n, first_per_key
from shelfspark.session import stored


def _notes(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, as an array."""
    texts = [
        F.when(F.coalesce(cond, F.lit(False)), F.lit(text) if isinstance(text, str) else text)
        for cond, text in pairs
    ]
    return F.filter(F.array(*texts), lambda t: t.isNotNull())


def validate(products: DataFrame) -> DataFrame:
    """Adds ``errors``, ``warnings`` and ``valid``."""
    mrp, asp = F.col("mrp"), F.col("asp")

    def blank(name: str) -> Column:
        return F.coalesce(strip(F.col(name)), F.lit("")) == ""
    swapped = F.concat(
        F.lit("asp "), money_text(asp), F.lit(" above mrp "), money_text(mrp), F.lit(": swapped?"),
    )
    return (
        products.withColumn("errors", _notes(
            (blank("name"), "blank name"),
            (blank("image_url"), "no image_url"),
            (blank("product_url"), "no product_url"),
            (mrp.isNull() & asp.isNull(), "no price: neither mrp nor asp"),
        ))
        .withColumn("warnings", _notes(
            (asp > mrp, swapped), (F.coalesce(mrp == 0, F.lit(False)) | F.coalesce(asp == 0, F.lit(False)), "a price of zero"),
        ))
        .withColumn("valid", ~(
            blank("name") | blank("image_url") | blank("product_url") | (mrp.isNull() & asp.isNull())
        ))
    )


def dedupe(products: DataFrame) -> DataFrame:
    """First product of every key per run, by discovery order."""
    return first_per_key(products, ["run_id", "product_key"], "discovery_ord")


def split_processed(links: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links still to do, ``(run_id, discovery_ord)`` of the known ones)."""
    done = processed.select("run_id", "product_key").distinct()
    keys = ["run_id", "product_key"]
    return links.join(done, keys, "left_anti"), links.join(done, keys, "left_semi").select("run_id", "discovery_ord")


def before_cap(rows: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Rows that a run met before its cap ended it: all, where no cap did."""
    if ends is None:
        return rows
    return rows.join(ends, "run_id", "left").where("_end IS NULL OR discovery_ord < _end").drop("_end")


def count_skipped(known: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """``(run_id, skipped)``: known links a run passed before its cap ended it."""
    return before_cap(known, ends).groupBy("run_id").agg(F.count("*").alias("skipped"))


def cap_ends(settled: DataFrame, caps: DataFrame) -> DataFrame:
    """``(run_id, _end)``: the place of the last exported row of runs that reach their cap.

    Only runs with as many exported rows as their cap are ranked.
    """
    exported = settled.where("outcome = 'exported'").select("run_id", "discovery_ord")
    full = exported.groupBy("run_id").agg(F.count("*").alias("_n")).join(caps.select("run_id", "max_products"), "run_id").where(
        (F.col("max_products") > 0) & (F.col("_n") >= F.col("max_products"))).select("run_id", F.col("max_products").cast("long").alias("_cap"))
    ranked = first_n(exported.join(full, "run_id"), ["run_id"], F.col("_cap"), ["discovery_ord"], rank="_rank")
    return ranked.where("_rank = _cap").select("run_id", F.col("discovery_ord").alias("_end"))


def cut_at(settled: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows behind the end of their run become ``not_reached``."""
    behind = F.coalesce(F.col("discovery_ord") > F.col("_end"), F.lit(False))
    return settled.join(ends, "run_id", "left").withColumn(
        "outcome", F.when(behind, "not_reached").otherwise(F.col("outcome"))).drop("_end")


def settle(products: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """Adds ``outcome`` to every row with ``run_id``, ``discovery_ord``, ``product_key``.

    ``failed``      extraction gave no product (``usable`` is False)
    ``invalid``     the product has validation errors
    ``duplicate``   a valid product with this key came earlier
    ``exported``    goes to the sink
    ``not_reached`` lies behind the run's product cap

    ``discovery_ord`` is unique per run.  The cap (``max_products``, 0 or no row: none) counts
    exported rows, so it becomes one position per run: the place of the last exported row.
    """
    rows = validate(products)
    if "usable" not in rows.columns:
        rows = rows.withColumn("usable", F.lit(True))
    # First valid place per key as an aggregate, so a hot key shrinks to a row
    # per task before the shuffle; the join back is one-to-many on both sides of
    # Spark's skew handling.
    good = F.col("usable") & F.col("valid")
    firsts = rows.where(good).groupBy("run_id", "product_key").agg(
        F.min("discovery_ord").alias("_first")
    )
    rows = rows.join(firsts, ["run_id", "product_key"], "left").withColumn(
        "outcome",
        F.when(~F.col("usable"), "failed").when(~F.col("valid"), "invalid")
        .when(F.col("discovery_ord") > F.col("_first"), "duplicate").otherwise("exported"),
    ).drop("_first")
    if caps is None:
        return rows
    rows = stored(rows)  # read for the ends and for the outcomes
    return cut_at(rows, cap_ends(rows, caps))


def processed_after(settled: DataFrame) -> DataFrame:
    """Keys to remember: valid products, duplicates too; invalid ones are retried."""
    return settled.where(F.col("outcome").isin("exported", "duplicate")).select("run_id", "product_key").distinct()


def preview(exported: DataFrame, rows: int) -> DataFrame:
    """The first rows of every run."""
    order = Window.partitionBy("run_id").orderBy("discovery_ord")
    return exported.withColumn("row_no", F.row_number().over(order)).where(F.col("row_no") <= rows)
