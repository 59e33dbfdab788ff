"""Queries of validation, identity, resume, caps, reports and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.config import PREVIEW_ROWS, JobConfig
from shelfspark.operators import quality as Q
from shelfspark.operators import reports as K
from shelfspark.operators.robots import robots_gate, robots_rules
from shelfspark.queries.registry import money, query
from shelfspark.rendering import storefront as R
from shelfspark.session import ensure_checkpoint_dir, stored
from shelfspark.sources.captures import processed_keys, read_processed, read_product_csv, read_run_csv, run_requests
from shelfspark.sources.sinks import clear_processed, csv_row, write_processed, write_product_csv, write_run_csv

_ID = "l_orderkey, l_linenumber, l_partkey"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_LINES = f"""WITH x AS (SELECT *, l_returnflag || l_linestatus AS run_id,
  l_tax = 0.08 AND l_discount = 0.1 AS blank, l_discount = 0.05 AS unpriced, l_quantity <> 13 AS usable FROM lineitem),
y AS (SELECT *, usable AND NOT blank AND NOT unpriced AS good FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY run_id, l_partkey, good ORDER BY {_ORDER}) AS nth FROM y),
o AS (SELECT *, CASE WHEN NOT usable THEN 'failed' WHEN NOT good THEN 'invalid' WHEN nth > 1 THEN 'duplicate' ELSE 'exported' END AS outcome FROM z),
w AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_ORDER}) AS place,
  sum(CASE WHEN outcome = 'exported' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS n_exp FROM o),
cap AS (SELECT run_id, 40 + 10 * (ascii(run_id) % 7) + ascii(substr(run_id, 2)) % 5 AS max_products FROM (SELECT DISTINCT run_id FROM o)),
c AS (SELECT w.*, max_products, CASE WHEN n_exp > max_products OR (n_exp = max_products AND outcome <> 'exported') THEN 'not_reached' ELSE outcome END AS capped
  FROM w JOIN cap USING (run_id))
"""


def _caps(lines):
    return lines.select("run_id").distinct().selectExpr(
        "run_id", "40 + 10 * (ascii(run_id) % 7) + ascii(substring(run_id, 2)) % 5 as max_products"
    )


@query("validated_products", _LINES + f"""
SELECT {_ID}, array_to_string(list_filter([CASE WHEN blank THEN 'blank name' END, CASE WHEN unpriced THEN 'no price: neither mrp nor asp' END], lambda t: t IS NOT NULL), '; ') AS errors,
  CASE WHEN unpriced THEN '' WHEN l_tax = 0.04 THEN 'a price of zero' WHEN l_tax = 0.07 THEN
    'asp ' || CAST(CAST(l_extendedprice + 1 AS DECIMAL(14,2)) AS VARCHAR) || ' above mrp ' || CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) || ': swapped?' ELSE '' END AS warnings,
  NOT (blank OR unpriced) AS valid FROM y""")
def validated_products(spark, sf_dir):
    """Q1 on a product per line item."""
    rows = Q.validate(R.line_products(spark, sf_dir))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "valid"
    )


@query("deduped_products", _LINES + f"""
SELECT {_ID}, run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, l_partkey ORDER BY {_ORDER}) AS rn FROM y) WHERE rn = 1""")
def deduped_products(spark, sf_dir):
    """Q2: first of every key per run."""
    return Q.dedupe(R.line_products(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "run_id")


@query("settled_products", _LINES + f"SELECT {_ID}, run_id, outcome FROM o")
def settled_products(spark, sf_dir):
    """Q1, Q2 and Q6 per row."""
    return Q.settle(R.line_products(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "run_id", "outcome")


@query("capped_products", _LINES + f"SELECT {_ID}, run_id, capped AS outcome FROM c")
def capped_products(spark, sf_dir):
    """Q4: every run with its own cap on exported rows."""
    lines = R.line_products(spark, sf_dir)
    return Q.settle(lines, _caps(lines)).select("l_orderkey", "l_linenumber", "l_partkey", "run_id", "outcome")


@query("processed_keys", _LINES + """
SELECT DISTINCT run_id, 'parts.example/details/' || l_partkey AS product_key FROM o WHERE outcome IN ('exported', 'duplicate')""")
def processed_after(spark, sf_dir):
    """Q5: valid rows are remembered, invalid and failed ones are not."""
    return Q.processed_after(Q.settle(R.line_products(spark, sf_dir)))


@query("resumed_products", _LINES + f"""
, done AS (SELECT DISTINCT run_id, l_partkey FROM y WHERE good AND l_linenumber = 1)
SELECT run_id, count(*) FILTER (d.l_partkey IS NULL) AS todo, count(d.l_partkey) AS skipped FROM y LEFT JOIN done d USING (run_id, l_partkey) GROUP BY run_id""")
def resumed_products(spark, sf_dir):
    """Q3: rows of known keys leave before any work, and are counted."""
    lines = R.line_products(spark, sf_dir)
    done = Q.validate(lines).where("usable and valid and l_linenumber = 1").select("run_id", "product_key")
    todo, known = Q.split_processed(lines, done)
    skipped = Q.count_skipped(known)
    counted = todo.groupBy("run_id").agg(F.count("*").alias("todo")).join(skipped, "run_id", "full")
    return counted.select("run_id", F.coalesce("todo", F.lit(0)).alias("todo"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


@query("run_report", _LINES + """
SELECT run_id, count(*) FILTER (capped IN ('exported', 'duplicate', 'invalid')) AS discovered, count(*) FILTER (capped = 'exported') AS exported, CAST(0 AS BIGINT) AS skipped,
  count(*) FILTER (capped = 'duplicate') AS duplicates, count(*) FILTER (capped = 'failed') AS failed, count(*) FILTER (capped = 'invalid') AS invalid FROM c GROUP BY run_id""")
def run_report(spark, sf_dir):
    """Q6 and K3 in one pass over the settled rows."""
    lines = R.line_products(spark, sf_dir)
    return K.run_counters(Q.settle(lines, _caps(lines)))


@query("run_warnings", _LINES + """
SELECT run_id, CASE WHEN l_tax = 0.04 THEN 'zero' ELSE 'swapped' END AS kind, count(*) AS n FROM o
WHERE usable AND NOT unpriced AND l_tax IN (0.04, 0.07) GROUP BY 1, 2""")
def run_warnings(spark, sf_dir):
    """Q8 by kind of warning."""
    settled = Q.settle(R.line_products(spark, sf_dir))
    notes = K.run_warnings(settled, K.run_counters(settled))
    kind = F.when(F.col("warning") == "a price of zero", "zero").when(F.col("warning").like("asp % above mrp %"), "swapped").otherwise(F.col("warning"))
    return notes.groupBy("run_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("product_preview", _LINES + f"""
SELECT run_id, {_ID}, CAST(rn AS BIGINT) AS row_no FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_ORDER}) AS rn FROM o WHERE outcome = 'exported') WHERE rn <= {PREVIEW_ROWS}""")
def product_preview(spark, sf_dir):
    """Q9: the first rows of every run."""
    settled = Q.settle(R.line_products(spark, sf_dir)).where("outcome = 'exported'")
    return Q.preview(settled, PREVIEW_ROWS).select("run_id", "l_orderkey", "l_linenumber", "l_partkey", F.col("row_no").cast("bigint").alias("row_no"))


# --------------------------------------------------------------------------
# Requests
# --------------------------------------------------------------------------
_RUNS = """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_custkey % (SELECT count(*) FROM supplier) AS s, o_orderkey % 40 AS d, o_orderkey % 17 <> 0 AS http,
  o_orderkey % 17 <> 0 AND coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_custkey * 7 - 100 END, 200) BETWEEN 1 AND 5000 AS valid,
  CAST(coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_custkey * 7 - 100 END, 200) AS BIGINT) AS max_products, o_orderpriority = '1-URGENT' AS skip, o_orderdate AS created_at FROM orders),
h AS (SELECT DISTINCT l_suppkey % (SELECT count(*) FROM supplier) AS s, l_partkey % 40 AS d, true AS seen FROM lineitem WHERE l_returnflag = 'R'),
rb AS (SELECT s_suppkey AS s, s_suppkey % 6 AS m FROM supplier),
j AS (SELECT r.*, seen, coalesce(m, 0) AS m, CAST(d AS VARCHAR) AS p FROM r LEFT JOIN h USING (s, d) LEFT JOIN rb USING (s)),
k AS (SELECT *, CASE m WHEN 2 THEN false WHEN 3 THEN p LIKE '10%' OR p NOT LIKE '1%' WHEN 4 THEN p NOT LIKE '2%' WHEN 5 THEN p NOT LIKE '35%' ELSE true END AS allowed FROM j),
st AS (SELECT *, CASE WHEN NOT valid THEN 'error' WHEN NOT skip AND NOT allowed THEN 'blocked' WHEN seen IS NULL THEN 'error' ELSE 'done' END AS status FROM k)
"""


def _statuses(spark, sf_dir):
    runs = run_requests(R.order_requests(spark, sf_dir))
    gate = robots_gate(runs.select("run_id", "url"), robots_rules(R.supplier_robots(spark, sf_dir), JobConfig().user_agent))
    captured = R.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr(
        f"concat('https://supplier-', l_suppkey % {R.suppliers(spark, sf_dir)}, '.example/details/', l_partkey % 40) as url"
    ).distinct()
    return K.run_status(runs, gate, runs.select("run_id", "url").join(captured, "url", "left_semi"))


@query("run_requests", _RUNS + "SELECT run_id, max_products, valid FROM r")
def requests(spark, sf_dir):
    """Caps in bounds, absolute http(s) addresses only."""
    return run_requests(R.order_requests(spark, sf_dir)).select("run_id", F.col("max_products").cast("bigint").alias("max_products"), "valid")


@query("run_status", _RUNS + """
SELECT run_id, status, CASE WHEN NOT http THEN 'url is no absolute http(s) address' WHEN NOT valid THEN 'max_products lies outside 1 to 5000' WHEN status = 'blocked' THEN
    'https://supplier-' || s || '.example/robots.txt forbids https://supplier-' || s || '.example/details/' || d
  WHEN status = 'error' THEN 'The seed page was not captured: the site may refuse robots, or the address is wrong.' END AS error,
  CASE WHEN skip THEN 'robots.txt was not asked, as requested.' END AS warning FROM st""")
def run_status(spark, sf_dir):
    """Q11: blocked, error or done for an order per run."""
    return _statuses(spark, sf_dir).select("run_id", "status", "error", "warning")


@query("job_records", _RUNS + """, cn AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(DISTINCT l_partkey) FILTER (l_quantity <> 13 AND l_discount <> 0.05 AND NOT (l_tax = 0.08 AND l_discount = 0.1)) AS exported FROM lineitem GROUP BY 1)
SELECT run_id, status, coalesce(exported, 0) AS exported, status = 'done' AND coalesce(exported, 0) > 0 AS has_csv FROM st LEFT JOIN cn USING (run_id)""")
def job_records(spark, sf_dir):
    """K4 and Q10: requests with the counters of their order's line items."""
    lines = R.line_products(spark, sf_dir).withColumn("run_id", F.col("l_orderkey").cast("string"))
    records = K.job_records(_statuses(spark, sf_dir), K.run_counters(Q.settle(lines)))
    return records.select("run_id", "status", "exported", "has_csv")


@query("newest_runs", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, dense_rank() OVER (ORDER BY o_orderdate DESC) AS day FROM orders")
def newest_runs(spark, sf_dir):
    """Q10: every run's record, newest first; ``day`` numbers the days of the records as they come."""
    lines = R.line_products(spark, sf_dir).withColumn("run_id", F.col("l_orderkey").cast("string"))
    records = K.job_records(_statuses(spark, sf_dir), K.run_counters(Q.settle(lines)))
    days = records.select("created_at").distinct().withColumn("day", F.dense_rank().over(Window.orderBy(K.run_order(records)[0])).cast("bigint"))
    return records.join(days, "created_at").select("run_id", "day")


# --------------------------------------------------------------------------
# Sinks
# --------------------------------------------------------------------------
def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/out-{uuid.uuid4().hex}"


@query("csv_roundtrip", """
SELECT name, category, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS subcategory, 'https://i.example/' || p_partkey AS image_url,
  CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) AS mrp, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '0.12' END AS asp, 'https://s.example/' || p_partkey AS product_url
FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN p_name || ', "large"' WHEN 1 THEN '  ' || p_name || ' ' WHEN 2 THEN p_name || chr(10) || 'two' WHEN 3 THEN 'é"' || p_name ELSE p_name END AS name,
  p_type AS category FROM part)""")
def csv_roundtrip(spark, sf_dir):
    """Quotes, commas, line breaks, spaces and empties survive."""
    products = R.table(spark, sf_dir, "part").selectExpr(
        "p_partkey as discovery_ord",
        """case p_partkey % 5 when 0 then concat(p_name, ', "large"') when 1 then concat('  ', p_name, ' ') when 2 then concat(p_name, '\\n', 'two')
            when 3 then concat('é"', p_name) else p_name end as name""",
        "p_type as category", "if(p_partkey % 2 = 0, null, p_brand) as subcategory", "concat('https://i.example/', p_partkey) as image_url",
        "cast(p_retailprice as decimal(28,10)) as mrp", "if(p_partkey % 4 = 0, null, cast(0.125 as decimal(28,10))) as asp",
        "concat('https://s.example/', p_partkey) as product_url",
    )
    folder = _folder(spark)
    write_product_csv(products, folder)
    return read_product_csv(spark, folder)


@query("run_csvs", _LINES + f"""
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY {_ORDER}) AS place, 'part ' || l_partkey AS name,
  'https://parts.example/details/' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '/?v=1' ELSE '' END AS product_url FROM o WHERE outcome = 'exported'""")
def run_csvs(spark, sf_dir):
    """A CSV per run in discovery order across its part files."""
    folder = _folder(spark)
    write_run_csv(Q.settle(R.line_products(spark, sf_dir)).where("outcome = 'exported'"), folder)
    return read_run_csv(spark, folder).select("run_id", "place", "name", "product_url")


@query("csv_rows", """
SELECT p_partkey, p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) AS mrp, '' AS category FROM part""")
def csv_rows(spark, sf_dir):
    """The text row of an export."""
    rows = R.table(spark, sf_dir, "part").selectExpr(
        "concat('https://s.example/', p_partkey) as product_url", "p_name as name", "cast(null as string) as category", "cast(null as string) as subcategory",
        "'https://i.example/x' as image_url", "cast(p_retailprice as decimal(28,10)) as mrp", "cast(null as decimal(28,10)) as asp",
    )
    return csv_row(rows).selectExpr("cast(substring(product_url, 19) as bigint) as p_partkey", "name", "mrp", "category")


@query("processed_state", _LINES + """
SELECT DISTINCT run_id, 'parts.example/details/' || l_partkey AS product_key FROM o
WHERE outcome IN ('exported', 'duplicate') AND (run_id LIKE '%F' OR l_linenumber = 2) AND run_id <> 'AF'""")
def processed_state(spark, sf_dir):
    """Two saves append, a clear replaces only its own runs, one of them by nothing."""
    folder = _folder(spark)
    # settled once: two saves and a clear read it
    settled = stored(Q.settle(R.line_products(spark, sf_dir)).select("run_id", "product_key", "l_linenumber", "outcome"))
    write_processed(Q.processed_after(settled.where("l_linenumber <> 1")), folder)
    write_processed(Q.processed_after(settled.where("l_linenumber = 1")), folder)
    cleared = settled.where("run_id like '%O' or run_id = 'AF'").select("run_id").distinct()
    clear_processed(Q.processed_after(settled.where("run_id like '%O' and l_linenumber = 2")), folder, cleared)
    return processed_keys(read_processed(spark, folder)).select("run_id", "product_key").distinct()
