"""Each stage against a plain version, and the whole run."""

import random

import pytest
from test_llm_near import brute

import corpus_pipeline as pipeline
from shelfspark.llm.decontaminate import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hit string, kept string"


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("tables")
    rows = []
    for i in range(120):
        words = [rng.choice(["the", "of", "and", f"w{rng.randrange(900)}"]) if i % 2 else rng.choice(["der", "die", "und", f"v{rng.randrange(900)}"]) for _ in range(60)]
        rows.append((i, " ".join(words), ["de", "en"][i % 2], f"s{i % 3}", 1, "x", None))
    for i in range(120, 160):  # near and exact copies
        words = rows[rng.randrange(20)][1].split(" ")
        if i % 3:
            words[rng.randrange(60)] = "changed"
        rows.append((i, " ".join(words), "en", None, None, "y", "z"))
    item = " ".join(f"item{j}" for j in range(14))
    rows += [(200, None, "en", "s0", 1, "x", "z"), (201, "", None, "s0", 1, None, None), (202, "12 34", "en", "s0", 1, "x", None), (203, " ".join(rows[7][1].split()[::-1]) + " " + item, "en", "s1", 1, "x", None),
             (204, item[:40], "en", "s1", 1, "x", None), (None, rows[9][1] + " und so weiter", "de", "s1", 1, "x", None), (31, rows[31][1], "en", "s1", 1, "x", None), (31, rows[31][1], "en", "s1", 1, "x", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages(spark, given):
    folder, rows = given
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(pipeline.STAGES)
    made = steps["language_id"](spark, docs, folder)
    assert made.schema == docs.schema
    left = [tuple(r) for r in made.collect()]
    assert {r[0] for r in rows} - {r[0] for r in left} == {200, 201, 202}

    made = steps["near_dedup"](spark, spark.createDataFrame(left, SCHEMA), folder)
    kept = {r[0] for r in brute([r[:2] for r in dict((r[0], r) for r in left if r[0] is not None).values()], 5) if r[3]}
    left = [tuple(r) for r in made.collect()]
    assert made.columns == docs.columns
    assert sorted((r[0] for r in left), key=str) == sorted([*kept, None], key=str)

    left = [tuple(r) for r in steps["decontamination"](spark, spark.createDataFrame(left, SCHEMA), folder).collect()]
    assert kept - {r[0] for r in left} == {203}

    mixed = [tuple(r) for r in steps["mixing"](spark, spark.createDataFrame(left, SCHEMA), folder).collect()]
    size = {s: sum(len(r[1].split()) for r in left if r[3] == s) for s in {r[3] for r in left}}
    took = {s: sum(len(r[1].split()) for r in mixed if r[3] == s) for s in size}
    assert set(mixed) <= set(left) and max(mixed.count(r) for r in mixed) <= 3
    assert abs(sum(took.values()) - sum(size.values())) <= 61 * len(size)

    out = steps["token_output"](spark, spark.createDataFrame(mixed, SCHEMA), folder).orderBy("start").collect()
    assert sorted((r["doc_id"] for r in out), key=str) == sorted((r[0] for r in mixed), key=str)
    assert [r["start"] for r in out[1:]] == [r["start"] + r["n_tokens"] for r in out[:-1]]
    assert len(words_of(b"a b")) == 2


def test_run_and_empty_tables(spark, given, tmp_path):
    folder, _ = given
    assert pipeline.run(spark, folder).count() > 50
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
