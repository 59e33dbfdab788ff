"""Totals of a run of more micro-batches than Spark remembers."""

from pyspark.sql import functions as F

from shelfspark.config import JobConfig
from shelfspark.streaming.jobs import PAGES_SCHEMA, captured_pages, page_products, progress_totals, start_product_stream


def test_totals_cover_forgotten_batches(spark, tmp_path):
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        for i in range(4):
            spark.createDataFrame([(i, f"https://a.example/p/{i}", "<html></html>", 200)], PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
        rows = page_products(captured_pages(spark, f"{tmp_path}/pages", files=1), "r", JobConfig())
        stream = start_product_stream(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        stream.awaitTermination()
        assert progress_totals(stream)["pages"] == 4
    finally:
        spark.conf.set(name, before)


def test_live_counter_and_state_after_a_restart(spark, tmp_path):
    from shelfspark.streaming.jobs import ProgressCounter
    product = ('<script type="application/ld+json">{{"@type":"Product","name":"{0}","image":"/i/{0}.png","offers":{{"price":"5"}}}}</script>').format
    counter = ProgressCounter()
    spark.streams.addListener(counter)
    try:
        for ids in ((5, 6), (7,), (1, 2, 8)):  # 1 comes late for product 1, of which 5 came first
            rows = [(i, f"https://a.example/p/{i % 4}", product(f"n{i}") if i != 6 else "<p>none</p>", 200) for i in ids]
            spark.createDataFrame(rows, PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
            rows = page_products(captured_pages(spark, f"{tmp_path}/pages"), "r", JobConfig())
            stream = start_product_stream(rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
            stream.awaitTermination()
            assert progress_totals(stream)["pages"] == len(ids)
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        assert (counter.pages, counter.products) == (6, 5)
    finally:
        spark.streams.removeListener(counter)
    got = {r.discovery_ord: (r.outcome, r.batch_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {5: ("exported", 0), 6: ("failed", 0), 7: ("exported", 1), 1: ("duplicate", 2), 2: ("exported", 2), 8: ("exported", 2)}


def test_a_file_that_arrives_is_parsed_by_several_tasks(spark, tmp_path):
    rows = spark.range(200).selectExpr("id as page_id", "concat('https://a.example/', id) as url", "'<p>x</p>' as html", "200 as status")
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages")
    dealt = captured_pages(spark, f"{tmp_path}/pages", files=1, tasks=4).withColumn("task", F.spark_partition_id())
    dealt.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 200 and out.select("task").distinct().count() == 4
