"""Exact price columns (decimals, never floats)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.config import MONEY
from shelfspark.functions.binding import let

#: First number in a text, with its separators. ``\p{Z}`` covers the
#: non-breaking spaces that ``\s`` leaves out.
PRICE_TOKEN = r"[0-9][0-9.,\s\p{Z}]*[0-9]|[0-9]"


def price_token(text: Column) -> Column:
    """The first number of a text without its spaces ('' when there is none)."""
    return F.replace(F.regexp_extract(text, PRICE_TOKEN, 0), F.lit(" "), F.lit(""))


def price_of_token(token: Column) -> Column:
    """Decide which separator is the decimal one, then cast exactly."""
    no_comma = F.replace(token, F.lit(","), F.lit(""))
    comma_as_point = F.replace(token, F.lit(","), F.lit("."))
    no_point = F.replace(token, F.lit("."), F.lit(""))
    comma, point = F.lit(","), F.lit(".")
    comma_is_last = F.instr(F.reverse(token), ",") < F.instr(F.reverse(token), ".")
    plain = (
        F.when(
            F.contains(token, comma) & F.contains(token, point),
            F.when(comma_is_last, F.replace(no_point, comma, point)).otherwise(no_comma),
        )
        .when(F.contains(token, comma) & token.rlike(",[0-9]{1,2}$"), comma_as_point)
        .otherwise(no_comma)
    )
    return plain.try_cast(MONEY)


def parse_price(text: Column) -> Column:
    """Price of a text column; NULL when it holds no usable number."""
    return price_of_token(price_token(text))


def parse_price_of(text: Column) -> Column:
    """``parse_price`` of a longer expression, which is computed once."""
    return let(price_token(text), price_of_token)


def parse_prices(texts: Column) -> Column:
    """Prices of a text array, element by element."""
    return F.transform(F.transform(texts, price_token), price_of_token)


def json_price(value: Column) -> Column:
    """Price of a VARIANT: numbers are taken as they are, texts are parsed."""
    def price(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(
            kind == "STRING", let(price_token(F.try_variant_get(v, "$", "string")), price_of_token)
        ).when(
            kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", MONEY)
        )
    return let(value, price)


def effective_price(sale: Column, promote: Column) -> Column:
    """What is paid: the promotion when it undercuts the list price."""
    return F.when(
        promote.isNotNull() & (sale.isNull() | (promote < sale)), promote
    ).otherwise(sale)


def money_text(c: Column) -> Column:
    """Two decimals, half-even; '' for NULL."""
    return F.coalesce(F.bround(c, 2).cast("decimal(28,2)").cast("string"), F.lit(""))
