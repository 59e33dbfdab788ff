"""Exact dedup: two Bloom passes mark hashes that may repeat; only their rows shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.cells import FILTER_BITS, pages, probe
from shelfspark.llm.common import SPACE, whole_text
from shelfspark.session import stored

def _cell(start: int, bits: int) -> Column:
    """A cell from 12 hex digits of the hash, so the two passes use independent ones."""
    return F.conv(F.substring("text_sha256", start, 12), 16, 10).cast("long") % bits


def _repeated_cells(rows: DataFrame, cell: str) -> DataFrame:
    """Bitmaps of the cells that two rows or more fall into.

    Counts per cell combine before they are sent, so a text that a third of all rows
    share arrives as one count per task.
    """
    return pages(F.col(cell), rows.groupBy(cell).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def exact_duplicates(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when they agree after each run of white space became one space; a null
    text is an empty one. The smallest doc_id of equal texts stays. Rows that repeat a
    doc_id count as rows of their group and get the same answer; a null doc_id never wins
    over another and is kept only if its whole group has none. Other columns are ignored.
    """
    rows = stored(docs.select(
        "doc_id", F.sha2(F.regexp_replace(whole_text(), SPACE + "+", " "), 256).alias("text_sha256")))
    first = rows.withColumn("c1", _cell(1, filter_bits))
    first = probe(first, _repeated_cells(first, "c1"), "c1", "m1").drop("c1")
    second = first.withColumn("c2", _cell(13, filter_bits))
    marked = probe(second, _repeated_cells(second.where("m1"), "c2"), "c2", "m2")
    alone = marked.where("NOT (m1 AND m2)").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    maybe = marked.where("m1 AND m2").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = maybe.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(met)
