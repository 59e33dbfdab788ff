"""The JSON listing feed: from captured envelopes to products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import variants as V
from shelfspark.functions.binding import let
from shelfspark.functions.money import effective_price, json_price
from shelfspark.functions.text import strip
from shelfspark.functions.urls import canonical_url, detail_url, flow_id, product_key, resolve_url
from shelfspark.operators.ranking import first_per_key
from shelfspark.session import stored

OK_RET = 200


# --------------------------------------------------------------------------
# Listings of a run
# --------------------------------------------------------------------------
def harvest_listings(
    seeds: DataFrame, base_url: str, crawl_site: bool = True, max_listings: int = 0
) -> DataFrame:
    """``(run_id, listing_rank, flow_id, listing_url)`` from seed pages' raw HTML.

    The seed's own listing comes first, the others in order of appearance.  All
    of it happens inside the row: no shuffle.
    """
    own = flow_id(F.col("seed_url"))
    own_list = F.when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>"))
    if crawl_site:
        seen = F.regexp_extract_all("html", F.lit("/activity/([0-9]+)"), 1)
        seen = F.coalesce(seen, F.array().cast("array<string>"))
        ids = F.array_distinct(F.concat(own_list, seen))
        if max_listings:
            ids = F.slice(ids, 1, max_listings)
    else:
        ids = own_list
    return seeds.select("run_id", F.posexplode(ids).alias("listing_rank", "flow_id")).withColumn(
        "listing_url", resolve_url(F.lit(base_url), F.concat(F.lit("/activity/"), F.col("flow_id")))
    )


# --------------------------------------------------------------------------
# Draining
# --------------------------------------------------------------------------
def envelopes(listing_pages: DataFrame) -> DataFrame:
    """``(flow_id, page_index, ok, has_next, ids, goods)``; a bad envelope is flagged.

    ``goods`` are the records as they came, ``ids`` their whole-number ids.
    """
    step = listing_pages
    status = F.coalesce("status", F.lit(200)) if "status" in step.columns else F.lit(200)
    step = step.select("flow_id", "page_index", (status < 400).alias("_up"), F.try_parse_json("body").alias("_e"))
    ret = F.try_variant_get("_e", "$.ret", "double")
    ret = F.when(V.kind_of(V.at(F.col("_e"), "$.ret")) != "STRING", ret)
    return step.select(
        "flow_id", "page_index",
        F.coalesce(
            F.col("_up") & (ret == OK_RET) & V.is_object(V.at(F.col("_e"), "$.data")), F.lit(False)
        ).alias("ok"),
        V.is_truthy(V.at(F.col("_e"), "$.data.hasNextPage")).alias("has_next"),
        F.try_variant_get("_e", "$.data.goodsList", "array<variant>").alias("goods"),
    ).select("flow_id", "page_index", "ok", "has_next", F.transform("goods", lambda g: V.int_at(g, "$.goodsId")).alias("ids"), "goods")


def listing_table(listing_pages: DataFrame) -> DataFrame:
    """Envelopes taken apart and written once: bodies are read and parsed here only.

    What finds the end of a drain reads ids and flags, and records are read for the pages of the drain.
    """
    return stored(envelopes(listing_pages))


def drain_stops(pages: DataFrame) -> DataFrame:
    """``(flow_id, stop_page, failed)``: where the drain of a listing ends.

    It ends at the first page without a next one, without a new id, with a bad
    envelope, or not captured at all.  Everything is a partial aggregate by
    (listing, page) or (listing, id), so one huge listing spreads over all tasks.
    """
    ids = pages.where("ok").select(
        "flow_id", "page_index",
        F.explode("ids").alias("goods_id"),
    ).where(F.col("goods_id").isNotNull())
    fresh = ids.groupBy("flow_id", "goods_id").agg(F.min("page_index").alias("page_index"))
    marks = [
        pages.select("flow_id", "page_index", F.lit(1).alias("here"), F.col("ok").cast("int").alias("ok"),
                     F.col("has_next").cast("int").alias("has_next"), F.lit(0).alias("fresh")),
        fresh.select("flow_id", "page_index", F.lit(0), F.lit(0), F.lit(0), F.lit(1)),
        # the page a listing needs next, and the first one
        pages.select("flow_id", F.col("page_index") + 1, F.lit(0), F.lit(0), F.lit(0), F.lit(0)),
        pages.select("flow_id", F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(0)),
    ]
    rows = marks[0].union(marks[1]).union(marks[2]).union(marks[3])
    grid = rows.groupBy("flow_id", "page_index").agg(
        F.max("here").alias("here"), F.max("ok").alias("ok"),
        F.max("has_next").alias("has_next"), F.sum("fresh").alias("fresh"),
    )
    bad = (F.col("here") == 0) | (F.col("ok") == 0)
    ends = grid.where(bad | (F.col("has_next") == 0) | (F.col("fresh") == 0))
    stop = F.min(F.struct("page_index", bad.alias("bad")))
    return ends.groupBy("flow_id").agg(stop.alias("_s")).select(
        "flow_id", F.col("_s.page_index").alias("stop_page"), F.col("_s.bad").alias("failed")
    )


def drained_goods(pages: DataFrame, stops: DataFrame, max_pages: int = 0) -> DataFrame:
    """``(flow_id, page_index, pos, goods_id, record)`` of the pages a drain reads.

    Pages behind the stop go before their records are exploded.  Repeats are
    left in; they go when the run is de-duplicated, in the one wide shuffle.
    """
    read = pages.join(stops, "flow_id").where(
        F.col("ok") & (F.col("page_index") <= F.col("stop_page"))
    )
    if max_pages:
        read = read.where(F.col("page_index") <= max_pages)
    return (
        read.select("flow_id", "page_index", F.posexplode(F.arrays_zip("ids", "goods")).alias("pos", "_r"))
        .select("flow_id", "page_index", "pos", F.col("_r.goods").alias("record"), F.col("_r.ids").alias("goods_id"))
        .where(F.col("goods_id").isNotNull())
    )


def first_goods(goods: DataFrame, listings: DataFrame) -> DataFrame:
    """Every id of a run once: the first listing that has it wins."""
    tagged = goods.join(listings.select("run_id", "listing_rank", "flow_id"), "flow_id")
    return first_per_key(tagged, ["run_id", "goods_id"], "listing_rank", "page_index", "pos")


def failed_listings(stops: DataFrame, listings: DataFrame, max_pages: int = 0, ends: DataFrame | None = None) -> DataFrame:
    """``(run_id, failed)``: listings that ended on a page that could not be read.

    A listing none of whose pages was captured fails too. A run that its cap ended
    (``ends``) has left only the listings before that of its last product to their end.
    """
    if ends is not None:
        last = ends.select("run_id", F.col("_end.listing_rank").alias("_last"))
        listings = listings.join(last, "run_id", "left").where("_last IS NULL OR listing_rank < _last").drop("_last")
    failed = F.coalesce("failed", F.lit(True))
    if max_pages:
        failed = failed & (F.coalesce("stop_page", F.lit(1)) <= max_pages)
    return listings.join(stops, "flow_id", "left").groupBy("run_id").agg(
        F.count_if(failed).alias("failed")
    )


# --------------------------------------------------------------------------
# Records to products
# --------------------------------------------------------------------------
def record_image(record: Column) -> Column:
    """Main image: the selected colourway first, then the others in order."""
    def source(i: Column) -> Column:
        return F.coalesce(*[
            F.nullif(V.at(i, f"$.{k}", "string"), F.lit(""))
            for k in ("goodsThumb", "skcMainImg", "colorPic")
        ])

    def pick(images: Column) -> Column:
        chosen = F.filter(images, lambda i: V.is_truthy(V.at(i, "$.select")))
        ordered = F.concat(F.slice(chosen, 1, 1), images)
        return F.get(F.filter(F.transform(ordered, source), lambda s: s.isNotNull()), F.lit(0))
    return let(F.filter(F.try_variant_get(record, "$.imageList", "array<variant>"), V.is_object), pick)


def feed_products(goods: DataFrame, base_url: str) -> DataFrame:
    """Product rows of unique goods; unusable records are dropped."""
    record = F.col("record")
    raw_name = V.at(record, "$.goodsName", "string")
    step = goods.select(
        "run_id", F.struct("listing_rank", "page_index", "pos").alias("discovery_ord"), "goods_id",
        strip(raw_name).alias("name"),
        canonical_url(record_image(record)).alias("image_url"),
        json_price(V.at(record, "$.salePrice")).alias("mrp"),
        json_price(V.at(record, "$.promotePrice")).alias("_promote"),
        canonical_url(detail_url(F.lit(base_url), raw_name, F.col("goods_id"))).alias("product_url"),
    )
    step = step.withColumn("asp", effective_price(F.col("mrp"), F.col("_promote")))
    usable = (
        (F.col("name") != "") & F.col("image_url").isNotNull() & (F.col("goods_id") != 0)
        & F.coalesce(F.col("mrp") >= 0, F.lit(True)) & F.coalesce(F.col("asp") >= 0, F.lit(True))
    )
    return step.where(usable).select(
        "run_id", "discovery_ord", "goods_id", "name",
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("subcategory"),
        "image_url", "mrp", "asp", "product_url", product_key(F.col("product_url")).alias("product_key"),
    )
