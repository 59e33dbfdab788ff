"""Helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the word rules, as a character class for every regex engine in use.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch: documents are large rows, and a worker holds what it makes of a batch beside it.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text() -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a number: the rule that holds rows out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def release() -> None:
    """Give a worker's freed memory back: workers outlive their tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def modest_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have BATCH_BYTES at most."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_shuffles(spark: SparkSession) -> None:
    """From now on a query of the session drops its shuffle files when it ends, not when the driver collects its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with modest batches; what a task has freed goes back at its end."""
    modest_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return df.mapInArrow(tidy, schema)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, lean: bool = False) -> DataFrame:
    """One Arrow batch in, one out; nothing is kept between batches. ``lean``: by ``in_arrow``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = each(batch) if batch.num_rows else None
            if made is not None:
                yield made
    return in_arrow(df, run, schema) if lean else df.mapInArrow(run, schema)


lean_batches = partial(map_batches, lean=True)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def shared_files(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path in it, for tasks that read or write there."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
