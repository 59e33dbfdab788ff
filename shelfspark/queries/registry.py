"""Named queries over the given tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir)`` function and its SQL, if SQL can say it."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def money(c: Column | str) -> Column:
    """Prices leave as doubles of two decimals, which every engine hashes alike."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)").cast("double")


#: The rendered goods, said once more in plain SQL over ``part``.
GOODS = """WITH g0 AS (
  SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size,
         lower(replace(p_brand, '#', '-')) || '.shop.example' AS host,
         CAST(substr(p_brand, 7) AS INT) AS b,
         CAST(round(p_retailprice * 100) AS BIGINT) + 100000 * (p_partkey % 3) AS mrp_c
  FROM part),
g AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN mrp_c - 100 * size ELSE mrp_c END AS asp_c,
         'https://' || host || '/details/' || replace(name, ' ', '-') || '-' || k AS url,
         row_number() OVER (PARTITION BY brand ORDER BY k) - 1 AS i,
         count(*) OVER (PARTITION BY brand) AS n
  FROM g0)
"""

#: Percent-encoding of a text, as SQL around an expression.
def encoded(expr: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({expr}, ''), lambda c: CASE WHEN "
        f"regexp_matches(c, '[\\x21-\\x7e]') THEN c ELSE url_encode(c) END), '')"
    )
