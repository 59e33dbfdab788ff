"""Filters of a fixed number of cells, as bitmap pages: made and probed with columns or in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import shared_files
from shelfspark.session import stored

#: Cells of a filter. Its size is fixed (2^26 bits are 8 MB), whatever the corpus; a corpus
#: that fills it lets more rows through to the exact steps and changes no result.
FILTER_BITS = 1 << 26
PAGE_BITS = 1 << 15  # bits of one bitmap that bitmap_construct_agg makes


def pages(cells: Column, rows: DataFrame) -> DataFrame:
    """page, bitmap: the cells that occur."""
    return rows.groupBy((cells / PAGE_BITS).cast("long").alias("page")).agg(F.bitmap_construct_agg(cells % PAGE_BITS).alias("bitmap"))


def probe(rows: DataFrame, bitmaps: DataFrame, cell: str, mark: str) -> DataFrame:
    """Set ``mark`` where the row's cell is in the bitmaps (an eighth of the cells in bytes at most, hence the broadcast)."""
    byte = F.conv(F.hex(F.expr(f"substring(bitmap, cast(({cell} % {PAGE_BITS}) / 8 as int) + 1, 1)")), 16, 10).cast("int")
    joined = rows.withColumn("page", (F.col(cell) / PAGE_BITS).cast("long")).join(F.broadcast(bitmaps), "page", "left")
    return joined.withColumn("_byte", byte).withColumn(
        mark, F.coalesce(F.expr(f"(shiftright(_byte, cast({cell} % 8 as int)) & 1) = 1"), F.lit(False))
    ).drop("page", "bitmap", "_byte")


class CellFilter:
    """The same pages, read by a task from the shared folder once per worker, which holds one filter at a time."""

    _held: dict[str, np.ndarray] = {}

    def __init__(self, bitmaps: DataFrame, bits: int):
        """``bitmaps``: page, bitmap, of cells below ``bits``, a power of two."""
        self.bits = bits
        self.files = stored(bitmaps).inputFiles()

    @classmethod
    def of(cls, hashes: DataFrame, bits: int) -> CellFilter:
        """``hashes``: a column ``h`` of 64-bit values."""
        return cls(pages(F.col("h").bitwiseAND(F.lit(bits - 1)), hashes), bits)

    @classmethod
    def forget(cls) -> None:
        """Let the worker's filter go, for a task that needs the room."""
        cls._held.clear()

    def __contains__(self, _) -> bool:
        raise TypeError("use has()")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        name = self.files[0] if self.files else ""
        if name not in self._held:
            self.forget()
            table = np.zeros(self.bits // 8, np.uint8)
            for uri in self.files:
                fs, path = shared_files(uri)
                found = ds.dataset(path, filesystem=fs, format="parquet").to_table()
                for page, bitmap in zip(found["page"].to_pylist(), found["bitmap"].to_pylist(), strict=True):
                    own = np.frombuffer(bitmap, np.uint8)
                    table[page * (PAGE_BITS // 8):][:len(own)] = own[:len(table) - page * (PAGE_BITS // 8)]
            self._held[name] = table
        cell = hashes & np.uint64(self.bits - 1)
        return (self._held[name][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
