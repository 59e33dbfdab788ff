"""One query for each operator, over the whole of its tables, with production parameters."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import LOWER, SPACE, UPPER, WORD, read_documents
from shelfspark.llm.decontaminate import decontaminate
from shelfspark.llm.exact_dedup import exact_duplicates
from shelfspark.llm.language import predict_languages
from shelfspark.llm.line_dedup import dedup_lines
from shelfspark.llm.mixing import mix
from shelfspark.llm.mixing_lm import held_out_fifth, score_texts
from shelfspark.llm.near_dedup import near_duplicates
from shelfspark.llm.nearest import code_vectors, search
from shelfspark.llm.periodic_runs import periodic_runs
from shelfspark.llm.quality_model import score_quality
from shelfspark.llm.registry import query
from shelfspark.llm.substring_dedup import dedup_substrings
from shelfspark.llm.token_alignment import align
from shelfspark.llm.token_files import read_tokens, token_folder, write_tokens

SQL_TEXT = "coalesce(text, '')"


@query("op1_near_dedup", f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate({SQL_TEXT}, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
             ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.root AS component_id, c.root = s.doc_id AS kept
FROM s JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c ON s.doc_id = c.doc_id
""")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), k=2)


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return read_tokens(write_tokens(docs, token_folder(docs), public_tokenizers.path("byte_bpe_50k.json")))


@query("op3_exact_dedup", f"""
WITH n AS (SELECT doc_id, sha256(regexp_replace({SQL_TEXT}, '{SPACE}+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_documents(spark, sf_dir))


@query("op4_mixing", f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all({SQL_TEXT}, '{WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight,
             CAST(3 * source_size AS DOUBLE) AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(weight *
        (SELECT min_by(level, (cap / weight, i)) FROM l WHERE level * weight <= cap), cap)) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS INT), 3) ELSE 0 END AS copies FROM t),
x AS (SELECT d.*, f.source_size, f.target, f.copies, f.target - f.copies * f.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY place) AS upto,
             sum(size) OVER (PARTITION BY d.source, place) AS n
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, copies + CASE WHEN 2 * upto - n <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_line_dedup", f"""
WITH l AS (
  SELECT doc_id, unnest(string_split({SQL_TEXT}, chr(10))) AS line,
         generate_subscripts(string_split({SQL_TEXT}, chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_documents(spark, sf_dir), held_out_fifth())


@query("op7_substring_dedup", f"""
WITH t AS (SELECT doc_id, hex(encode({SQL_TEXT})) AS x FROM documents),
w AS (SELECT doc_id, x, unnest(generate_series(0, CAST(len(x) / 2 AS BIGINT) - 50)) AS i FROM t WHERE len(x) >= 100),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM w),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
h AS (SELECT s.doc_id, i FROM s JOIN f ON s.g = f.g AND f.first < s.doc_id),
r AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM h),
n AS (SELECT doc_id, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, k),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS s, list(b ORDER BY a) AS e FROM p GROUP BY doc_id)
SELECT t.doc_id, CAST(len(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN x ELSE array_to_string(list_transform(generate_series(0, len(s)), lambda j:
         substr(x, CASE WHEN j = 0 THEN 1 ELSE 2 * e[j] + 1 END,
                CASE WHEN j = len(s) THEN len(x) ELSE 2 * (s[j + 1] - CASE WHEN j = 0 THEN 0 ELSE e[j] END) END)), '') END)) AS kept_sha256
FROM t LEFT JOIN c ON t.doc_id = c.doc_id
""")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read_documents(spark, sf_dir))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op10_decontaminate", f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate({SQL_TEXT}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate({SQL_TEXT}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, item, dw.n, i FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op11_nearest", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
                 AND list_bool_or(list_transform(embedding, lambda c: coalesce(c <> 0, false)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.x, c.x) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""")
def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(code_vectors(vectors), vectors.where(F.col("vec_id") % 50 == 0))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align(read_documents(spark, sf_dir), *paths, groups=False)[0]


def periodic_rewrite(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: every tenth document (by crc32 of its id) repeats a block of its words from some word on; without an id none does."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * ((n - a) // p + 1))[:n - a]


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_documents(spark, sf_dir), rewrite=periodic_rewrite, texts=False)
