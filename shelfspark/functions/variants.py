"""Reading loosely typed JSON (VARIANT) without ever raising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.binding import let


def at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(value), F.lit("OBJECT")), F.lit(False))


def string_at(value: Column, path: str) -> Column:
    """The value at a path only if it is a JSON string."""
    return let(at(value, path), lambda v: F.when(kind_of(v) == "STRING", at(v, "$", "string")))


def int_at(value: Column, path: str) -> Column:
    """The value at a path only if it is a JSON integer (not "79", not true)."""
    return let(at(value, path), lambda v: F.when(kind_of(v) == "BIGINT", at(v, "$", "bigint")))


def first_item(value: Column, path: str) -> Column:
    """A value that may be wrapped in a list: the list's first item, else itself."""
    return let(at(value, path), lambda v: F.coalesce(at(v, "$[0]"), v))


def is_truthy(value: Column) -> Column:
    """JSON null, false, 0, "", [] and {} count as nothing."""
    def counts(v: Column, kind: Column) -> Column:
        text = at(v, "$", "string")
        return (
            F.when(kind == "STRING", text != "")
            .when(kind == "BOOLEAN", at(v, "$", "boolean"))
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), at(v, "$", "double") != 0)
            .when(kind == "VOID", F.lit(False))
            .otherwise(~text.isin("[]", "{}"))
        )
    named = let(value, lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))
    return F.coalesce(let(named, lambda s: counts(s["v"], s["kind"])), F.lit(False))


def first_truthy(values: Column) -> Column:
    """First value that counts as something, else the last one."""
    return let(values, lambda vs: F.coalesce(
        F.get(F.filter(vs, is_truthy), F.lit(0)), F.get(vs, F.size(vs) - 1)
    ))
