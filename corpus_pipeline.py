"""Corpus pipeline: raw documents to token files in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents`` as they came, further columns included. ``run`` writes what a stage
returns as Parquet to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.cells import FILTER_BITS, pages, probe
from shelfspark.llm.common import modest_batches, read_documents
from shelfspark.llm.decontaminate import clean_documents
from shelfspark.llm.language import accepted, fit_languages, held_out
from shelfspark.llm.mixing import mixed_documents
from shelfspark.llm.near_dedup import near_duplicates
from shelfspark.llm.token_files import read_tokens, token_folder, write_tokens
from shelfspark.session import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language ID rejects: null texts, texts without letters, texts far from every language learned."""
    modest_batches(spark)
    return accepted(docs, fit_languages(docs.where(~held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest doc_id.

    Of rows that repeat a kept doc_id one stays, the one of the smallest text; rows without
    doc_id all stay.
    """
    modest_batches(spark)
    decided = stored(near_duplicates(docs, k=5, percent=80).groupBy("doc_id").agg(
        F.bool_or("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("doc_id IS NOT NULL AND (NOT _kept OR _n > 1)"))
    # a filter of fixed size lets the texts pass that nothing is decided about; only the others shuffle
    cell = F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(F.lit(FILTER_BITS - 1))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), cell.alias("_cell"))
    marked = probe(packed, stored(pages(cell, decided)), "_cell", "_hit")
    met = marked.where("_hit").join(decided, F.col("_row.doc_id") == F.col("doc_id"), "left")
    first = met.where("_kept AND _n > 1").groupBy("doc_id").agg(F.min_by("_row", F.struct("_row.text", F.xxhash64("_row"))).alias("_row"))
    parts = (marked.where("NOT _hit"), met.where("_n IS NULL OR (_kept AND _n = 1)"), first)
    return reduce(DataFrame.unionByName, [x.select("_row.*") for x in parts])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    modest_batches(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it: not at all, or up to three times."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return, per row, what they hold: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(write_tokens(docs, token_folder(docs), public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The language, near-dedup and token stages have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
