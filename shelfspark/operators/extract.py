"""Product fields of a parsed page.

Each strategy is a struct of the same six nullable fields.  A chain is a list of
strategies; merging takes every field from the first strategy that has it.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.config import (
    BREADCRUMB_SELECTORS,
    IMAGE_HINTS,
    IMAGE_NOISE,
    MONEY,
    JobConfig,
)
from shelfspark.functions import nodes as N
from shelfspark.functions import variants as V
from shelfspark.functions.binding import let
from shelfspark.functions.money import effective_price, json_price, parse_price_of
from shelfspark.functions.text import (
    category_pair,
    clean,
    collapse,
    is_separator,
    nonblank,
    split_category_path,
    strip,
)
from shelfspark.functions.urls import canonical_url, product_key, resolve_url
from shelfspark.operators.taxonomy import with_labels

FIELDS = {
    "name": "string", "image_url": "string", "mrp": MONEY, "asp": MONEY,
    "category": "string", "subcategory": "string",
}

#: Strategy chains: a site with a known detail object, and any other site.
SITE_CHAIN = ("embedded", "structured", "breadcrumbs", "selectors", "fallback")
GENERIC_CHAIN = ("structured", "breadcrumbs", "heuristics", "fallback")

#: Columns of a parsed page.
NODES, TEXTS = "nodes", "texts"


def field_struct(**given: Column) -> Column:
    return F.struct(*[
        given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FIELDS.items()
    ])


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _present(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


# --------------------------------------------------------------------------
# JSON-LD
# --------------------------------------------------------------------------
def _display_name(element: Column) -> Column:
    """Own name of an element, else the name of its nested item."""
    return F.coalesce(
        clean(V.string_at(element, "$.name")), clean(V.string_at(element, "$.item.name"))
    )


def category_crumbs(value: Column) -> Column:
    """Crumbs of a category value: a path text, a list or a named object."""
    def crumbs(v: Column) -> Column:
        items = F.try_variant_get(v, "$", "array<variant>")
        text = F.when(V.is_object(v), _display_name(v)).otherwise(V.string_at(v, "$"))
        return F.coalesce(
            nonblank(F.transform(items, lambda i: V.at(i, "$", "string"))),
            let(clean(text), split_category_path),
            F.array().cast("array<string>"),
        )
    return let(value, crumbs)


def _product_block(p: Column) -> Column:
    """The fields one Product object offers, before the blocks are folded."""
    image = let(V.first_item(p, "$.image"), lambda v: F.coalesce(V.at(v, "$.url"), v))
    # the offer's price, then that of its price specification, where there is one
    offers = let(V.first_item(p, "$.offers"), lambda o: F.array(o, V.first_item(o, "$.priceSpecification")))
    lists = V.first_truthy(F.array(V.at(p, "$.mrp"), V.at(p, "$.listPrice"), V.at(p, "$.highPrice")))
    return F.struct(
        clean(V.at(p, "$.name", "string")).alias("name"),
        V.string_at(image, "$").alias("image"),
        F.transform(
            F.filter(offers, V.is_object), lambda o: json_price(V.at(o, "$.price"))
        ).alias("asks"),
        json_price(lists).alias("list_price"),
        category_crumbs(V.at(p, "$.category")).alias("crumbs"),
    )


def _nonzero_first(prices: Column) -> Column:
    """A zero only counts when nothing better follows; otherwise the last word."""
    return let(prices, lambda ps: F.coalesce(
        _first(F.filter(ps, lambda v: v != 0)), F.get(ps, F.size(ps) - 1)
    ))


@cache
def _products() -> Column:
    return F.transform(
        F.filter("ld", lambda b: b["product"].isNotNull()),
        lambda b: _product_block(F.try_parse_json(b["product"])),
    )


@cache
def _name_and_image_at() -> Column:
    """Places of the first block with a name and of the first with an image."""
    def place(part: str) -> Column:
        known = F.transform("_products", lambda b: b[part].isNotNull())
        return F.array_position(known, F.lit(True)).cast("int").alias(part)
    return F.struct(place("name"), place("image"))


@cache
def _used_blocks() -> Column:
    """Blocks are read until a name and an image are known."""
    name, image = F.col("_at.name"), F.col("_at.image")
    upto = F.when((name > 0) & (image > 0), F.greatest(name, image)).otherwise(F.size("_products"))
    return F.slice("_products", F.lit(1), upto)


def _first_of_used(part: str) -> Column:
    return _first(_present(F.transform("_used", lambda b: b[part])))


@cache
def _structured_pair() -> Column:
    """Categories of the first block that has one; the name counts once it is known."""
    name_at = F.col("_at.name")
    pairs = F.transform("_used", lambda b, i: category_pair(
        b["crumbs"], F.when((name_at > 0) & (i + 1 >= name_at), _first_of_used("name"))
    ))
    return _first(F.filter(pairs, lambda p: p["category"].isNotNull()))


@cache
def _structured() -> Column:
    return field_struct(
        name=_first_of_used("name"),
        image_url=resolve_url(F.col("url"), _first_of_used("image")),
        asp=_nonzero_first(F.flatten(F.transform("_used", lambda b: b["asks"]))),
        mrp=_nonzero_first(F.transform("_used", lambda b: b["list_price"])),
        category=F.col("_pair.category"),
        subcategory=F.col("_pair.subcategory"),
    )


# --------------------------------------------------------------------------
# Breadcrumbs
# --------------------------------------------------------------------------
def _trail_of_list(block: Column) -> Column:
    """Names of a BreadcrumbList by position, else by place in the list."""
    items = F.try_variant_get(F.try_parse_json(block), "$.itemListElement", "array<variant>")
    placed = F.transform(items, lambda e, i: F.struct(
        F.coalesce(V.int_at(e, "$.position"), i.cast("bigint")).alias("position"),
        i.alias("i"),
        F.when(V.is_object(e), _display_name(e)).alias("name"),
    ))
    return F.transform(
        F.array_sort(F.filter(placed, lambda p: p["name"].isNotNull())), lambda p: p["name"]
    )


def _trail_of_container(container: Column) -> Column:
    """Crumb texts inside one container, first appearance first."""
    def text(n: Column) -> Column:
        given = F.when(N.attr(n, "itemprop") == "name", F.nullif(N.attr(n, "content"), F.lit("")))
        return collapse(F.coalesce(given, N.text_of(TEXTS, n, " ")))
    items = F.filter(
        N.subtree(NODES, container),
        lambda n: n["tag"].isin("li", "a", "span")
        | F.coalesce(N.attr(n, "itemprop") == "name", F.lit(False)),
    )
    return F.array_distinct(
        F.filter(F.transform(items, text), lambda t: (t != "") & ~is_separator(t))
    )


@cache
def _trail() -> Column:
    """The page's crumbs: list markup, else a category path, else navigation."""
    lists = F.transform(
        F.filter("ld", lambda b: b["crumbs"].isNotNull()), lambda b: _trail_of_list(b["crumbs"])
    )
    paths = F.transform("_products", lambda b: b["crumbs"])
    containers = F.flatten(F.array(*[N.select(NODES, s) for s in BREADCRUMB_SELECTORS]))
    dom = F.transform(containers, _trail_of_container)
    return F.coalesce(
        _first(F.filter(lists, lambda t: F.size(t) > 0)),
        _first(F.filter(paths, lambda t: F.size(t) > 0)),
        _first(F.filter(dom, lambda t: F.size(t) > 1)),
    )


@cache
def _trail_pair() -> Column:
    heading = clean(N.first_text(NODES, TEXTS, "h1"))
    return category_pair(F.col("crumbs"), F.coalesce(heading, N.meta(NODES, "og:title")))


# --------------------------------------------------------------------------
# Selectors, heuristics, fallback, embedded detail
# --------------------------------------------------------------------------
def _first_filled(n: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(N.attr(n, a), F.lit("")) for a in names])


@cache
def selectors_fields(config: JobConfig) -> Column:
    sel = config.selectors
    images = F.transform(
        N.select(NODES, sel.image), lambda n: _first_filled(n, "content", "src", "data-src")
    )
    return field_struct(
        name=clean(N.first_text(NODES, TEXTS, sel.name)),
        image_url=resolve_url(F.col("url"), _first(_present(images))),
        mrp=parse_price_of(N.first_text(NODES, TEXTS, sel.mrp)),
        asp=parse_price_of(N.first_text(NODES, TEXTS, sel.asp)),
    )


@cache
def heuristic_fields() -> Column:
    """Microdata, then conventions, then position; needs ``own_prices``."""
    named = let(
        N.first(NODES, "[itemprop='name']"),
        lambda n: F.coalesce(_first_filled(n, "content"), N.text_of(TEXTS, n)),
    )
    name = F.coalesce(clean(named), clean(N.first_text(NODES, TEXTS, "h1")))

    def filled(attribute: str):
        return lambda n: _first_filled(n, attribute, "src")
    hints = [
        let(N.first(NODES, selector), filled(attribute))
        for selector, attribute in IMAGE_HINTS
    ]

    def side(n: Column, name: str) -> Column:
        return F.coalesce(F.trim(N.attr(n, name)).try_cast("bigint"), F.lit(0))

    photos = F.filter(
        F.transform(
            F.filter(NODES, lambda n: n["tag"] == "img"),
            lambda n: F.struct(
                (side(n, "width") * side(n, "height")).alias("area"),
                (-n["id"]).alias("early"),
                _first_filled(n, "src", "data-src").alias("src"),
            ),
        ),
        lambda p: p["src"].isNotNull() & ~F.lower(p["src"]).rlike("|".join(IMAGE_NOISE)),
    )
    return field_struct(
        name=name,
        image_url=resolve_url(F.col("url"), F.coalesce(*hints, F.array_max(photos)["src"])),
        mrp=F.array_max("own_prices"),
        asp=F.array_min("own_prices"),
    )


@cache
def fallback_fields() -> Column:
    return field_struct(
        name=F.coalesce(F.nullif(N.meta(NODES, "og:title"), F.lit("")), N.title(NODES, TEXTS)),
        image_url=resolve_url(F.col("url"), F.nullif(N.meta(NODES, "og:image"), F.lit(""))),
    )


@cache
def _detail() -> Column:
    """What an embedded detail object says; category ids stay numbers."""
    d = F.col("_v")
    def text(path: str, of: Column = d) -> Column:
        return F.nullif(V.at(of, path, "string"), F.lit(""))
    photos = F.transform(
        F.try_variant_get(d, "$.images", "array<variant>"),
        lambda i: F.coalesce(text("$.picThumb", i), text("$.picUrl", i)),
    )
    sale, promote = json_price(V.at(d, "$.salesPrice")), json_price(V.at(d, "$.promotePrice"))
    paid = let(
        F.struct(sale.alias("sale"), promote.alias("promote")),
        lambda s: effective_price(s["sale"], s["promote"]),
    )
    return F.struct(
        clean(F.coalesce(text("$.goodsName"), text("$.shortGoodsName"))).alias("name"),
        F.coalesce(_first(_present(photos)), text("$.goodsThumb")).alias("image"),
        sale.alias("mrp"),
        paid.alias("asp"),
        V.int_at(d, "$.level2CatId").alias("level2_id"),
        V.int_at(d, "$.level3CatId").alias("level3_id"),
    )


# --------------------------------------------------------------------------
# Chains
# --------------------------------------------------------------------------
def merge(*strategies: Column) -> Column:
    """Field by field, the first strategy that has a value wins."""
    return field_struct(**{
        name: F.coalesce(*[s[name] for s in strategies]) for name in FIELDS
    })


def extract_fields(
    signals: DataFrame, chain: tuple[str, ...], config: JobConfig, taxonomy: DataFrame | None = None
) -> DataFrame:
    """Adds one struct per strategy of the chain and their merge as ``fields``.

    ``signals`` is the output of ``with_signals``.  Node arrays are dropped as
    soon as the strategies have been read off, before any join.
    """
    step = (
        signals.withColumn("_products", _products()).withColumn("_at", _name_and_image_at())
        .withColumn("_used", _used_blocks())
        .withColumns({"_pair": _structured_pair(), "crumbs": _trail()})
        .withColumn("_trail_pair", _trail_pair())
    )
    strategies = {
        "structured": _structured(),
        "breadcrumbs": field_struct(
            category=F.col("_trail_pair.category"), subcategory=F.col("_trail_pair.subcategory")
        ),
        "fallback": fallback_fields(),
    }
    if "selectors" in chain:
        strategies["selectors"] = selectors_fields(config)
    if "heuristics" in chain:
        strategies["heuristics"] = heuristic_fields()
    kept = [c for c in signals.columns if c not in ("nodes", "texts", "ld", "detail")]
    step = step.select(*kept, "crumbs", "detail", *[c.alias(n) for n, c in strategies.items()])
    if "embedded" in chain:
        if taxonomy is None:
            raise ValueError("the embedded strategy needs a taxonomy")
        step = step.withColumn("_v", F.try_parse_json("detail")).withColumn("_d", _detail()).withColumns(
            {"level2_id": F.col("_d.level2_id"), "level3_id": F.col("_d.level3_id")}
        )
        step = with_labels(step, taxonomy, "level2_id", "level3_id", "_category", "_subcategory")
        step = step.withColumn("embedded", field_struct(
            name=F.col("_d.name"), image_url=resolve_url(F.col("url"), F.col("_d.image")),
            mrp=F.col("_d.mrp"), asp=F.col("_d.asp"),
            category=F.col("_category"), subcategory=F.col("_subcategory"),
        ))
        kept = [*kept, "level2_id", "level3_id"]
    return step.select(*kept, "crumbs", *chain, merge(*[F.col(s) for s in chain]).alias("fields"))


def is_complete(fields: Column) -> Column:
    return F.coalesce((fields["name"] != "") & (fields["image_url"] != ""), F.lit(False))


def looks_like_product(fields: Column, is_product_page: Column) -> Column:
    """The sampling test: complete, a price above zero, and a product page."""
    priced = (F.coalesce(fields["asp"], F.lit(0)) != 0) | (F.coalesce(fields["mrp"], F.lit(0)) != 0)
    return is_complete(fields) & priced & is_product_page


def build_products(extracted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Product rows with ``usable``: False marks a page that failed extraction."""
    f = F.col("fields")

    def not_negative(p: Column) -> Column:
        return F.coalesce(p >= 0, F.lit(True))
    url, image = canonical_url(F.col("url")), canonical_url(f["image_url"])
    return extracted.select(
        *keep,
        strip(f["name"]).alias("name"),
        f["category"].alias("category"),
        f["subcategory"].alias("subcategory"),
        image.alias("image_url"),
        f["mrp"].alias("mrp"),
        f["asp"].alias("asp"),
        url.alias("product_url"),
        product_key(url).alias("product_key"),
        (
            is_complete(f) & url.isNotNull() & image.isNotNull()
            & not_negative(f["mrp"]) & not_negative(f["asp"])
        ).alias("usable"),
    )
