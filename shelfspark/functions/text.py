"""Text, slug and category-path columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.binding import let
from shelfspark.config import CRUMB_SEPARATORS, PATH_SEPARATORS, ROOT_CRUMBS

#: Every character Unicode counts as white space; ``trim`` takes a set.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def clean(c: Column) -> Column:
    """Stripped text, or NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs become one space."""
    return F.trim(F.regexp_replace(c, _SPACE_RUN, " "))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(collapse(a)) == F.lower(collapse(b))


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-")
    return F.trim(dashed, F.lit("-"))


def run_id(url: Column) -> Column:
    return F.concat(F.lit("run_"), F.substring(F.sha1(url.cast("binary")), 1, 12))


def nonblank(items: Column) -> Column:
    """Stripped items of a text array, without the blank ones."""
    return F.filter(F.transform(items, strip), lambda x: x != "")


def split_category_path(c: Column) -> Column:
    """Split by the first separator that occurs anywhere in the text."""
    def parts(text: Column) -> Column:
        return reduce(
            lambda rest, sep: F.when(
                F.contains(text, F.lit(sep)), F.split(text, rf"\Q{sep}\E")
            ).otherwise(rest),
            reversed(PATH_SEPARATORS),
            F.array(text),
        )
    return nonblank(let(c, parts))


def is_separator(c: Column) -> Column:
    return F.trim(c, F.lit(" \xa0")).isin(*CRUMB_SEPARATORS)


def category_pair(crumbs: Column, product_name: Column) -> Column:
    """``struct(category, subcategory)`` of a trail.

    Root crumbs go from the front only, the product's own name from the end
    only; the next two crumbs are the pair.
    """
    def is_root(c: Column) -> Column:
        return F.trim(F.lower(c), F.lit(" >/|")).isin(*ROOT_CRUMBS)

    def without_roots(tidy: Column) -> Column:
        start = F.array_position(F.transform(tidy, lambda c: ~is_root(c)), F.lit(True))
        return F.when(start > 0, F.slice(tidy, start.cast("int"), F.greatest(F.size(tidy), F.lit(1))))

    def without_name(rest: Column, name: Column) -> Column:
        ends = (name != "") & same_text(F.get(rest, F.size(rest) - 1), name)
        return F.when(F.coalesce(ends, F.lit(False)), F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)

    rest = let(nonblank(crumbs), without_roots)
    kept = let(
        F.struct(rest.alias("rest"), product_name.alias("name")),
        lambda s: without_name(s["rest"], s["name"]),
    )
    return let(kept, lambda k: F.struct(
        F.get(k, F.lit(0)).alias("category"), F.get(k, F.lit(1)).alias("subcategory")
    ))
