"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import WORD, whole_text
from shelfspark.session import stored

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: A document's place is 48 bits of a hash of its id, read 12 bits (4,096 buckets) at a time.
LEVELS, STEP = 4, 12


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: weights share all tokens, none above ``cap`` times its source.

    ``sizes`` has one row per source. Resharing the excess until none is above ends where
    the targets are min(cap * size, weight * level) with one level for all, so the sources
    are taken in order of cap * size / weight and the first that fits gives the level. The
    windows hold one row per source, never one per document.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_i", F.row_number().over(every) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    limit = ranked.withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    order = Window.orderBy((F.col("_cap") / F.col("weight")), "_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    fitted = limit.withColumn("_level", level).withColumn(
        "_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "_i", "_level"))).over(whole)["_level"])
    return fitted.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))).alias("target"))


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with _source, _size and _place: 48 bits of a hash of the id."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.withColumns({
        "_source": F.col("source").cast("string"), "_size": F.regexp_count(whole_text(), F.lit(WORD)).cast("long"),
        "_place": F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")})


def _thresholds(rows: DataFrame, weights, cap: int) -> DataFrame:
    """source, source_size, target, full (copies of every document), _edge (one more below this place)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0)
    # what the partial copy may still take, and the prefix of the bucket where it ends
    edge = stored(targets.withColumn("full", full.cast("int")).withColumn(
        "budget", F.col("target") - F.col("full") * F.col("source_size")).withColumn("_edge", F.lit(0).cast("long")).withColumn("_below", F.lit(0).cast("long")))
    for level in range(LEVELS):
        shift = STEP * (LEVELS - 1 - level)
        e = edge.select(F.col("source").alias("_s"), "_edge", "_below", "budget")
        inside = rows.join(e, F.col("source").eqNullSafe(F.col("_s"))).where(F.shiftright("place", shift + STEP) == F.col("_edge"))
        histogram = inside.groupBy("source", "_below", "budget", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        summed = histogram.withColumn("_upto", F.col("_below") + F.sum("n").over(run))
        # the first bucket in which more lies than the budget takes, by half of what the bucket holds at the last level
        over = (2 * F.col("_upto") - F.col("n") > 2 * F.col("budget")) if level == LEVELS - 1 else (F.col("_upto") > F.col("budget"))
        found = summed.where(over).groupBy(F.col("source").alias("_s")).agg(
            F.min(F.struct("bucket", (F.col("_upto") - F.col("n")).alias("below"))).alias("f"))
        # where nothing is over, the edge lies right behind the bucket (a source taken whole: behind the last)
        edge = stored(edge.drop("_below").join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", "full", "budget",
            F.coalesce("f.bucket", F.shiftleft(F.col("_edge") + 1, STEP)).alias("_edge"),
            F.coalesce("f.below", F.lit(0).cast("long")).alias("_below")))
    return edge.select("source", "source_size", "target", "full", "_edge")


def _copies(rows: DataFrame, edges: DataFrame, source: str, place: str, cap: int) -> DataFrame:
    """``rows`` with source_size, target and _copies; the edges are one row per source, which Spark broadcasts if they are small."""
    e = edges.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "full", "_edge")
    return rows.join(e, F.col(source).eqNullSafe(F.col("_s"))).withColumn(
        "_copies", F.least(F.col("full") + (F.col(place) < F.col("_edge")).cast("int"), F.lit(cap))).drop("_s", "full", "_edge")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of ``docs``.

    ``copies`` says how often the mix takes the document, up to ``cap`` times. The budgets
    of the copies are nested: all of a source fits one copy before any of it gets a second,
    so only one copy of a source is partial, and its documents are those whose hash lies
    below a threshold. The threshold is found by summing tokens by source and hash bucket
    and looking again only into the bucket where the budget ends. Nothing is sorted, and
    reruns agree. Null text has size 0; a null source is a source of its own, the last;
    documents of equal hash (repeated ids) stay together.
    """
    rows = stored(_placed(docs.select("doc_id", "text", "source")).select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_place").alias("place")))
    return _copies(rows, _thresholds(rows, weights, cap), "source", "place", cap).select(
        "doc_id", "source", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"),
        (F.col("size") * F.col("_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it; texts are not shuffled for it."""
    # the row travels as one column, so that its names can't clash
    placed = _placed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")).drop("doc_id", "text", "source")
    rows = stored(placed.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_place").alias("place")))
    chosen = _copies(placed.drop("_size"), _thresholds(rows, weights, cap), "_source", "_place", cap).where("_copies > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
