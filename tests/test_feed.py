"""Draining listings against a plain reading of the rules."""

import json

from pyspark.sql import functions as F

from shelfspark.operators import feed as G
from shelfspark.operators.quality import settle
from shelfspark.operators.reports import run_counters, run_warnings


def body(ids, has_next, ret=200, **extra):
    goods = [{"goodsId": i, "goodsName": f"N {i}", "salePrice": "10", "imageList": [{"goodsThumb": f"https://i.example/{i}"}], **extra} for i in ids]
    return json.dumps({"ret": ret, "data": {"goodsList": goods, "hasNextPage": has_next}})


def drained(spark, pages, max_pages=0):
    df = spark.createDataFrame([("7", p, s, b) for p, s, b in pages], "flow_id string, page_index int, status int, body string")
    env = G.envelopes(df)
    stops = G.drain_stops(env)
    listings = spark.createDataFrame([("r", 0, "7")], "run_id string, listing_rank int, flow_id string")
    goods = G.first_goods(G.drained_goods(env, stops, max_pages), listings)
    ids = [r.goods_id for r in goods.orderBy("page_index", "pos").collect()]
    return ids, G.failed_listings(stops, listings, max_pages).collect()[0].failed


def test_stop_rules(spark):
    full = [(1, 200, body(range(20), True)), (2, 200, body(range(20, 40), True)), (3, 200, body(range(40, 45), False))]
    assert drained(spark, full) == (list(range(45)), 0)
    assert drained(spark, full, max_pages=2) == (list(range(40)), 0)
    assert drained(spark, [*full[:2], (3, 200, body(range(20), True)), (4, 200, body([99], False))]) == (list(range(40)), 0)
    assert drained(spark, [full[0], (2, 200, body([], True, ret=500)), full[2]]) == (list(range(20)), 1)
    assert drained(spark, [full[0], (2, 200, "not json")]) == (list(range(20)), 1)
    assert drained(spark, [full[0], full[2]]) == (list(range(20)), 1)
    assert drained(spark, [(2, 200, body([1], False))]) == ([], 1)
    assert drained(spark, [(1, 404, body([1], False))]) == ([], 1)
    assert drained(spark, [(1, 200, body(["5", 6, True, 6], False))]) == ([6], 0)


def test_records_to_products(spark):
    cases = [
        ({"goodsName": "A", "imageList": [{"goodsThumb": "https://i.example/a"}, {"select": True, "skcMainImg": "https://i.example/b"}]}, "https://i.example/b"),
        ({"goodsName": "A", "imageList": [{"select": True}, {"colorPic": "https://i.example/c"}]}, "https://i.example/c"),
        ({"goodsName": " ", "imageList": [{"goodsThumb": "https://i.example/a"}]}, None),
        ({"goodsName": "A", "imageList": []}, None),
        ({"goodsName": "A", "imageList": [{"goodsThumb": "https://i.example/a"}], "salePrice": -1}, None),
        ({"goodsName": "A", "imageList": [{"goodsThumb": "i.jpg"}]}, None),
    ]
    rows = [("r", 0, 1, i, i + 1, json.dumps(c)) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "run_id string, listing_rank int, page_index int, pos int, goods_id bigint, j string")
    got = {r.goods_id: r.image_url for r in G.feed_products(df.withColumn("record", F.parse_json("j")), "https://s.example").collect()}
    assert [got.get(i + 1) for i in range(len(cases))] == [want for _, want in cases]


def test_harvest_puts_the_seed_first(spark):
    html = '<a href="/activity/222">a</a><a href="/activity/111?x">b</a>"/activity/222"'
    seeds = spark.createDataFrame([("r", "https://s.example/activity/111", html), ("q", "https://s.example/", html), ("e", "https://s.example/", "")],
                                  "run_id string, seed_url string, html string")
    rows = G.harvest_listings(seeds, "https://s.example").orderBy("run_id", "listing_rank").collect()
    assert [(r.run_id, r.flow_id) for r in rows] == [("q", "222"), ("q", "111"), ("r", "111"), ("r", "222")]
    capped = G.harvest_listings(seeds, "https://s.example", max_listings=1).collect()
    assert sorted((r.run_id, r.flow_id) for r in capped) == [("q", "222"), ("r", "111")]
    only = G.harvest_listings(seeds, "https://s.example", crawl_site=False).collect()
    assert [(r.run_id, r.flow_id) for r in only] == [("r", "111")]


def product(ord_, key, mrp=10, asp=10, name="n", usable=True):
    return ("r", ord_, name, "https://i.example/1", mrp, asp, f"https://s.example/{key}", f"s.example/{key}", usable)


SCHEMA = "run_id string, discovery_ord int, name string, image_url string, mrp int, asp int, product_url string, product_key string, usable boolean"


def test_settling(spark):
    rows = [product(0, "a", None, None), product(1, "a"), product(2, "a"), product(3, "b", 5, 6), product(4, "c", usable=False),
            product(5, "d", 0, 0), product(6, "e", name=" "), product(7, "f")]
    df = spark.createDataFrame(rows, SCHEMA)
    settled = settle(df)
    assert [r.outcome for r in settled.orderBy("discovery_ord").collect()] == [
        "invalid", "exported", "duplicate", "exported", "failed", "exported", "invalid", "exported"]
    counters = run_counters(settled).collect()[0]
    assert (counters.discovered, counters.exported, counters.duplicates, counters.failed, counters.invalid) == (7, 4, 1, 1, 2)
    notes = sorted(r.warning for r in run_warnings(settled, run_counters(settled)).collect())
    assert notes == ["a price of zero", "asp 6.00 above mrp 5.00: swapped?"]
    caps = spark.createDataFrame([("r", 2)], "run_id string, max_products int")
    capped = [r.outcome for r in settle(df, caps).orderBy("discovery_ord").collect()]
    assert capped == ["invalid", "exported", "duplicate", "exported"] + ["not_reached"] * 4


def test_silent_runs_say_so(spark):
    settled = settle(spark.createDataFrame([product(0, "a", usable=False)], SCHEMA))
    notes = [r.warning for r in run_warnings(settled, run_counters(settled)).collect()]
    assert notes == ["The run ended without a product."]
