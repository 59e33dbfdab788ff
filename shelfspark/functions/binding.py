"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used several times is otherwise copied as often, and copies of
    copies multiply; a lambda variable keeps plans small.  It leaves whole-stage
    code generation, so plain columns do not need it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
