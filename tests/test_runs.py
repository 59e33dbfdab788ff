"""Whole runs and helpers on small inputs, hot groups included."""

import random

from pyspark.sql import functions as F

from shelfspark.config import JobConfig
from shelfspark.operators.ranking import first_n, first_per_key, with_place
from shelfspark.plans.admission import admit_runs
from shelfspark.plans.runs import crawl_run, page_facts
from shelfspark.sources.captures import captures_for_keys, read_sitemap_files
from shelfspark.sources.sinks import write_report

S = "https://s.example"


def product(name, price="5"):
    return (f'<script type="application/ld+json">{{"@type":"Product","name":"{name}","image":"/i/{name}.png",'
            f'"offers":{{"price":"{price}"}}}}</script>')


def pages_of(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_crawl(spark):
    links = "".join(f'<a href="/d/{i}">x</a>' for i in range(5))
    pages = [
        (f"{S}/all", links + '<a rel="next" href="/all?page=2">n</a>'),
        (f"{S}/all?page=2", '<a href="/d/5">x</a><a href="/d/0/?again">x</a><a href="/e/9">x</a>'),
        *[(f"{S}/d/{i}", product(f"n{i}")) for i in range(5)],
        (f"{S}/d/0?late=1", product("later capture")),
        ("https://one.example/p", product("alone")),
        ("https://none.example/p", "<p>nothing</p>"),
        ("https://plain.example/", "".join(f'<a href="/x/{i}">x</a>' for i in range(4))),
    ]
    seeds = [("many", f"{S}/all"), ("one", "https://one.example/p"), ("none", "https://none.example/p"), ("plain", "https://plain.example"), ("gone", f"{S}/gone")]
    runs = spark.createDataFrame(seeds, "run_id string, seed_url string")
    result = crawl_run(runs, pages_of(spark, pages), JobConfig())
    rows = {(r.run_id, r.product_key, r.name, r.outcome) for r in result.settled.collect()}
    assert rows == {("many", f"s.example/d/{i}", f"n{i}", "exported") for i in range(5)} | {
        ("many", "s.example/d/5", None, "failed"), ("one", "one.example/p", "alone", "exported")}
    assert {r.run_id: r.template for r in result.patterns.collect()} == {"many": "/d/*", "one": "single product page", "plain": None}
    notes = {(r.run_id, r.warning.split(",")[0].split(" (")[0]) for r in result.warnings.collect()}
    assert notes == {("none", "No product links on the seed page"), ("plain", "The seed page has links"), ("plain", "Tried the 1 largest shapes of links")}


def test_stored_facts_replace_pages(spark, tmp_path):
    pages = pages_of(spark, [(f"{S}/all", "".join(f'<a href="/d/{i}">x</a>' for i in range(3)))] + [(f"{S}/d/{i}", product(f"n{i}")) for i in range(3)])
    write_report(page_facts(pages, JobConfig()), str(tmp_path / "facts"))
    runs = spark.createDataFrame([("r", f"{S}/all")], "run_id string, seed_url string")
    done = spark.createDataFrame([("r", "s.example/d/1"), ("q", "s.example/d/2")], "run_id string, product_key string")
    result = crawl_run(runs, None, JobConfig(), processed=done, facts=spark.read.parquet(str(tmp_path / "facts")))
    assert sorted(r.name for r in result.exported.collect()) == ["n0", "n2"]
    assert result.counters.collect()[0].skipped == 1


def test_admission(spark):
    requests = spark.createDataFrame(
        [("a", f" {S}/x ", 9999, False), ("b", f"{S}/private", 0, False), ("c", f"{S}/private", 5, True), ("d", "nope", 5, False), ("e", f"{S}/missing", 5, False)],
        "run_id string, url string, max_products int, ignore_robots boolean")
    robots = spark.createDataFrame([(S, 200, "User-agent: *\nDisallow: /private")], "origin string, status int, body string")
    adapters = spark.createDataFrame([("s.example", "sitemap")], "domain string, source string")
    pages = pages_of(spark, [(f"{S}/x", "x"), (f"{S}/private/", "x")])
    got = {r.run_id: (r.status, r.max_products, r.source) for r in admit_runs(requests, robots, adapters, pages, JobConfig()).collect()}
    assert got == {"a": ("error", 9999, "sitemap"), "b": ("error", 0, "sitemap"), "c": ("done", 5, "sitemap"), "d": ("error", 5, "generic"), "e": ("error", 5, "sitemap")}


def test_first_capture_is_chosen_on_narrow_columns(spark):
    pages = pages_of(spark, [(f"{S}/a?1", "first"), (f"{S}/a", "second"), (f"{S}/b", None), (f"{S}/c", "c")])
    keys = spark.createDataFrame([("s.example/a",), ("s.example/b",)], "product_key string")
    assert [(r.product_key, r.html) for r in captures_for_keys(keys, pages).collect()] == [("s.example/a", "first")]


def test_ranks_with_a_hot_group(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"k{i % 50}", i, rng.randrange(1000)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, n bigint, v int").repartition(8)
    groups = {}
    for g, n, v in data:
        groups.setdefault(g, []).append((v, n))
    got = {(r.g, r.n, r["rank"]) for r in first_n(df, ["g"], 7, ["v", "n"]).collect()}
    assert got == {(g, n, i + 1) for g, rows in groups.items() for i, (_, n) in enumerate(sorted(rows)[:7])}
    assert {(r.g, r.n) for r in first_per_key(df, ["g"], "v", "n").collect()} == {(g, min(rows)[1]) for g, rows in groups.items()}
    placed = {(r.g, r.n): (r.i, r.m) for r in with_place(df, ["g"], "n", 100, "i", "m").collect()}
    for g, rows in groups.items():
        numbers = sorted(n for _, n in rows)
        assert all(placed[(g, n)] == (i, len(numbers)) for i, n in enumerate(numbers))


def test_sitemap_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"<urlset/>")
    row = read_sitemap_files(spark, str(tmp_path)).collect()[0]
    assert row.url.endswith("/a.xml") and bytes(row.body) == b"<urlset/>" and row.status == 200


def test_known_products_are_not_parsed_and_count_up_to_the_cap(spark, monkeypatch):
    from shelfspark.plans import runs as plan
    links = "".join(f'<a href="/d/{i}">x</a>' for i in range(8))
    pages = pages_of(spark, [(f"{S}/all", links)] + [(f"{S}/d/{i}", product(f"n{i}")) for i in range(8)] + [("https://t.example/d/1", product("other"))])
    runs = spark.createDataFrame([("r", f"{S}/all")], "run_id string, seed_url string")
    done = spark.createDataFrame([("r", f"s.example/d/{i}") for i in (3, 6, 7)], "run_id string, product_key string")
    caps = spark.createDataFrame([("r", 4)], "run_id string, max_products int")
    parsed = []
    whole = plan.page_facts
    monkeypatch.setattr(plan, "page_facts", lambda p, c: parsed.append(p) or whole(p, c))
    result = crawl_run(runs, pages, JobConfig(), processed=done, caps=caps)
    assert sorted(r.name for r in result.exported.collect()) == ["n0", "n1", "n2", "n4"]
    assert result.counters.collect()[0].skipped == 1  # 6 and 7 lie behind the cap
    last = {r.url.removeprefix(S) for r in parsed[-1].collect()}
    assert last == {"/all", "/d/0", "/d/1", "/d/2", "/d/4", "/d/5"}


def test_caps_above_any_bound_hold(spark):
    from shelfspark.operators.quality import settle
    rows = spark.range(7000).selectExpr(
        "'r' as run_id", "id as discovery_ord", "cast(id as string) as product_key", "'n' as name", "'i' as image_url", "'u' as product_url",
        "cast(2 as decimal(28,10)) as mrp", "cast(1 as decimal(28,10)) as asp")
    for cap, want in ((6000, 6000), (0, 7000), (9000, 7000)):
        caps = spark.createDataFrame([("r", cap)], "run_id string, max_products int")
        assert settle(rows, caps).where("outcome = 'exported'").count() == want


def test_a_run_without_a_pattern_walks_nowhere(spark):
    pages = pages_of(spark, [(f"{S}/all", '<a href="/x/1">a</a><a href="/x/2">a</a><a href="/x/3">a</a><a rel="next" href="/all?page=2">n</a>'), (f"{S}/all?page=2", "x")])
    runs = spark.createDataFrame([("r", f"{S}/all")], "run_id string, seed_url string")
    result = crawl_run(runs, pages, JobConfig(max_listing_pages=1))
    assert not [r for r in result.warnings.collect() if "listing pages" in r.warning]


def exchanged(df, column):
    """Exchanges of a plan that carry a column."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = text.split("\n\n")
    return [p for p in parts if " Exchange" in p.split("\n")[0] and f"{column}#" in p]


def spied(monkeypatch):
    """The captures given to each parse of a crawl, and the parse itself."""
    from shelfspark.operators import clusters
    from shelfspark.plans import runs as plan
    seen = []
    whole, light, verdicts = plan.page_facts, plan.page_links, clusters.parse_pages
    monkeypatch.setattr(plan, "page_facts", lambda p, c: seen.append((p, whole(p, c))) or seen[-1][1])
    monkeypatch.setattr(plan, "page_links", lambda p: seen.append((p, light(p))) or seen[-1][1])
    monkeypatch.setattr(clusters, "parse_pages", lambda p: seen.append((p, verdicts(p))) or seen[-1][1])
    return seen


def test_captures_behind_the_cap_are_never_parsed(spark, monkeypatch):
    links = ["".join(f'<a href="/d/{i:03}">x</a>' for i in range(p * 50, p * 50 + 50)) for p in range(4)]
    lists = [(f"{S}/all" + (f"?page={p + 1}" if p else ""), links[p] + (f'<a rel="next" href="/all?page={p + 2}">n</a>' if p < 3 else "")) for p in range(4)]
    # most of the first 60 products are gone, so the first piece is not enough
    goods = [(f"{S}/d/{i:03}", "<p>gone</p>" if i % 4 and 3 < i < 60 else product(f"n{i}")) for i in range(200)]
    runs = spark.createDataFrame([("capped", f"{S}/all"), ("free", "https://t.example/all")], "run_id string, seed_url string")
    other = [(u.replace("s.example", "t.example"), h) for u, h in [lists[3], *goods[150:]]]
    other[0] = ("https://t.example/all", other[0][1])
    caps = spark.createDataFrame([("capped", 12), ("free", 0)], "run_id string, max_products int")
    seen = spied(monkeypatch)
    result = crawl_run(runs, pages_of(spark, lists + goods + other), JobConfig(), caps=caps)
    names = {r.name for r in result.exported.where("run_id = 'capped'").collect()}
    assert names == {f"n{i}" for i in (0, 1, 2, 3, 4, 8, 12, 16, 20, 24, 28, 32)}
    assert result.exported.where("run_id = 'free'").count() == 50
    parsed = {r.url.split(".example")[1] for p, _ in seen for r in p.where("url like '%s.example%'").select("url").collect()}
    assert "/all?page=4" in parsed and "/d/023" in parsed
    assert not {f"/d/{i:03}" for i in range(96, 200)} & parsed
    outcomes = {r.outcome: r["count"] for r in result.settled.where("run_id = 'capped'").groupBy("outcome").count().collect()}
    assert outcomes["not_reached"] == 200 - 12 - outcomes["failed"]


def test_bodies_are_not_exchanged_when_a_crawl_resumes(spark, monkeypatch):
    links = "".join(f'<a href="/d/{i}">x</a>' for i in range(8))
    pages = pages_of(spark, [(f"{S}/all", links)] + [(f"{S}/d/{i}", product(f"n{i}")) for i in range(8)] + [("https://t.example/d/1", product("other"))])
    runs = spark.createDataFrame([("r", f"{S}/all")], "run_id string, seed_url string")
    done = spark.createDataFrame([("r", f"s.example/d/{i}") for i in (3, 6, 7)], "run_id string, product_key string")
    seen = spied(monkeypatch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = crawl_run(runs, pages, JobConfig(), processed=done, caps=spark.createDataFrame([("r", 4)], "run_id string, max_products int"))
        assert sorted(r.name for r in result.exported.collect()) == ["n0", "n1", "n2", "n4"]
        assert len(seen) >= 4
        for _, parsed in seen:
            assert not exchanged(parsed, "html")
        joined = pages.join(done, pages.url == done.product_key)
        assert exchanged(joined, "html")  # the test sees what it looks for
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_next_page_that_looks_like_a_product(spark):
    links = "".join(f'<a href="/d/{i}">x</a>' for i in range(4))
    pages = pages_of(spark, [(f"{S}/all", links + '<a rel="next" href="/d/more">n</a>'), (f"{S}/d/more", '<a href="/d/9">x</a><a rel="next" href="/d/last">n</a>'),
                             (f"{S}/d/last", '<a href="/d/10">x</a>')] + [(f"{S}/d/{i}", product(f"n{i}")) for i in (0, 1, 2, 3, 9, 10)])
    runs = spark.createDataFrame([("r", f"{S}/all")], "run_id string, seed_url string")
    assert sorted(r.name for r in crawl_run(runs, pages, JobConfig()).exported.collect()) == ["n0", "n1", "n10", "n2", "n3", "n9"]


def test_members_are_never_lost(spark):
    from shelfspark.operators import membership as M
    rows = spark.range(200_000).withColumns({"k": F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50_000), "_page": F.lit(1)})
    keys = rows.where("id % 11 = 0 or k is null").select("k")
    kept = M.keep_members(rows, keys, "k")
    assert kept.columns == rows.columns
    wanted = rows.join(keys.distinct(), rows.k.eqNullSafe(keys.k), "left_semi")
    assert wanted.exceptAll(kept).count() == 0
    assert kept.count() < wanted.count() * 1.05
    assert M.filter_bits(0) == M.LEAST_BITS and M.filter_bits(1 << 40) == M.MOST_BITS and M.filter_bits(1 << 20) == 1 << 26


def test_details_behind_the_cap_are_not_read(spark, monkeypatch):
    from shelfspark.operators import enrich as E
    from shelfspark.plans.runs import feed_run
    def page(listing, index, ids, more):
        goods = ",".join(f'{{"goodsId":{i},"goodsName":"n{i}","salePrice":5,"imageList":[{{"goodsThumb":"https://i.example/{i}"}}]}}' for i in ids)
        return (listing, index, 200, f'{{"ret":200,"data":{{"hasNextPage":{str(more).lower()},"goodsList":[{goods}]}}}}')
    listing = spark.createDataFrame([page("1", 1, range(1, 6), True), page("1", 2, range(6, 11), False), ("2", 1, 500, "x")], "flow_id string, page_index int, status int, body string")
    listings = spark.createDataFrame([("r", 0, "1"), ("r", 1, "2")], "run_id string, listing_rank int, flow_id string")
    details = spark.createDataFrame([(f"shop.example/details/n{i}-{i}", i, f'x {{"goodsId":{i},"level2CatId":{i}}}') for i in range(1, 11)], "product_key string, page_id int, html string")
    caps = spark.createDataFrame([("r", 3)], "run_id string, max_products int")
    seen, whole = [], E.embedded_details
    monkeypatch.setattr(E, "embedded_details", lambda p: seen.append(p) or whole(p))
    result = feed_run(listing, listings, JobConfig(base_url="https://shop.example/"), details=details, caps=caps)
    assert result.exported.count() == 3 and result.counters.collect()[0].failed == 0
    assert sorted(r.page_id for r in seen[0].collect()) == [1, 2, 3]
