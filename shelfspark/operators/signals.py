"""Is a page about one product, and which of its prices are its own?

On a listing every price sits in a small box that links elsewhere; on a product
page at least one stands free.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.config import (
    CARD_MAX_DEPTH,
    CARD_MAX_TEXT,
    CARD_TAGS,
    MONEY,
    PRICE_SELECTOR,
    STRUCTURED_PRICE_SELECTORS,
)
from shelfspark.functions import nodes as N
from shelfspark.functions.binding import let
from shelfspark.functions.money import parse_prices


def card_href(nodes: Column, price: Column) -> Column:
    """Link of the product card around a price node; NULL when it stands free.

    The nearest ancestor that decides wins: a card tag with too much text means
    the price is free, a card tag with a link means it is carded.
    """
    ancestors, up = [], price
    for _ in range(CARD_MAX_DEPTH):
        up = F.get(nodes, up["parent"])
        ancestors.append(up)

    def link(node: Column) -> Column:
        return N.attr(F.get(nodes, node["link"]), "href")

    cards = F.filter(
        F.array(*ancestors), lambda a: F.coalesce(a["tag"].isin(*CARD_TAGS), F.lit(False))
    )
    verdicts = F.transform(
        cards,
        lambda a: F.struct(
            (a["text_len"] > CARD_MAX_TEXT).alias("region"), link(a).alias("href")
        ),
    )
    deciding = F.filter(verdicts, lambda v: v["region"] | v["href"].isNotNull())
    return let(F.get(deciding, F.lit(0)), lambda v: F.when(~v["region"], v["href"]))


def has_product_markup(nodes: Column, ld: Column) -> Column:
    """An explicit machine-readable "this page is one product"."""
    og_types = F.filter(nodes, lambda n: (n["tag"] == "meta") & (N.attr(n, "property") == "og:type"))
    og = F.lower(N.attr(F.get(og_types, F.lit(0)), "content")) == "product"
    micro = F.exists(nodes, N.matcher(nodes, "[itemtype*='schema.org/Product' i]"))
    json_ld = F.exists(ld, lambda b: F.contains(F.lower(b["raw"]), F.lit('"product"')))
    return F.coalesce(og, F.lit(False)) | micro | json_ld


def _price_texts(texts: Column, found: Column) -> Column:
    """What a price node says: content, else data-price, else its text."""
    return F.transform(
        found,
        lambda n: F.coalesce(
            F.nullif(N.attr(n, "content"), F.lit("")),
            F.nullif(N.attr(n, "data-price"), F.lit("")),
            N.text_of(texts, n),
        ),
    )


def _positive(prices: Column) -> Column:
    return F.filter(prices, lambda p: p > 0)


# Columns are built once per process: they name the columns of a parsed page and
# hold no data.  Building one costs a call into the JVM per function in it.
@cache
def _price_nodes() -> Column:
    return N.select("nodes", PRICE_SELECTOR)


@cache
def _free_nodes() -> Column:
    return F.filter("_price_nodes", lambda n: card_href("nodes", n).isNull())


@cache
def _markup() -> Column:
    return has_product_markup("nodes", "ld")


@cache
def _own_prices() -> Column:
    """Prices of the first structured source that has any, else the free ones."""
    nodes, texts = "nodes", "texts"
    # structured sources are price nodes themselves, so the short list is enough
    structured = [
        _positive(parse_prices(_price_texts(
            texts, F.filter("_price_nodes", N.matcher(nodes, selector))
        )))
        for selector in STRUCTURED_PRICE_SELECTORS
    ]
    free = _positive(parse_prices(_price_texts(texts, F.col("_free_nodes"))))
    sources = F.filter(F.array(*structured, free), lambda s: F.size(s) > 0)
    return F.coalesce(F.get(sources, F.lit(0)), F.array().cast(f"array<{MONEY}>"))


def with_signals(parsed: DataFrame) -> DataFrame:
    """Adds n_prices, n_free, n_carded, product_markup, is_product_page, own_prices."""
    found = parsed.withColumn("_price_nodes", _price_nodes()).withColumn("_free_nodes", _free_nodes())
    counted = found.withColumns({
        "n_prices": F.size("_price_nodes"), "n_free": F.size("_free_nodes"),
        "product_markup": _markup(), "own_prices": _own_prices(),
    })
    return counted.select(
        *parsed.columns, "n_prices", "n_free", (F.col("n_prices") - F.col("n_free")).alias("n_carded"),
        "product_markup", (F.col("product_markup") | (F.col("n_free") > 0)).alias("is_product_page"),
        "own_prices",
    )


def signal_report(signals: DataFrame) -> DataFrame:
    """Pages and price nodes per verdict."""
    return (
        signals.groupBy(F.when(F.col("is_product_page"), "product").otherwise("listing").alias("verdict"))
        .agg(
            F.count("*").alias("pages"),
            F.sum("n_prices").alias("prices"),
            F.sum("n_free").alias("free"),
            F.sum("n_carded").alias("carded"),
        )
    )
