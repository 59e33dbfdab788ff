"""Which rows of a wide table have a key of a narrow one, without moving the wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import stored

#: Bits for each key, and the smallest and largest filter (32 MB): the bound of what is broadcast.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
_PAGE = 1 << 15  # bits of a bitmap that bitmap_construct_agg makes


def filter_bits(keys: int) -> int:
    """A power of two with about BITS_PER_KEY for each key, between the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def keep_members(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` whose ``key`` is among those of ``keys``, and a few others.

    A bitmap of the keys' hashes is sized from their number and broadcast, so ``rows`` are
    filtered where they are read. One in BITS_PER_KEY of the other rows passes too, more where
    MOST_BITS are not enough; a caller joins its narrow results on the key. No member is lost.
    A null key is a key.
    """
    keys = stored(keys.select(key).distinct())
    bits = filter_bits(keys.count())
    cell = F.xxhash64(key).bitwiseAND(F.lit(bits - 1))
    page = F.floor(cell / _PAGE)
    bitmaps = keys.groupBy(page.alias("_member_page")).agg(F.bitmap_construct_agg(cell % _PAGE).alias("_member_bits"))
    byte = F.conv(F.hex(F.expr("substring(_member_bits, cast((_member_cell % 32768) / 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = rows.withColumns({"_member_cell": cell, "_member_page": page}).join(F.broadcast(bitmaps), "_member_page")
    return met.where(F.getbit(byte, F.col("_member_cell") % 8) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])
