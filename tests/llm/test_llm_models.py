"""Language ID and quality: held-out accuracy, a plain tree walk, hard cases."""

import os
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm.language import fit_languages, identify, predict_languages
from shelfspark.llm.queries import op8_language, op9_quality
from shelfspark.llm.quality_model import FEATURES, fit_trees, score_quality, statistics

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_languages_held_out(spark):
    got = op8_language(spark, SF_DIR).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF_DIR}/documents.parquet'").fetchall())
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(got) == len(lang) and all(0 <= r["score"] <= 1 for r in got)
    right = np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held])
    assert right > 0.95, right
    assert np.mean([r["rejected"] for r in got]) < 0.05


def test_language_hard_cases(spark):
    rows = [(i, ["the cat and the dog", "der hund und die katze"][i % 2] + f" {i}", ["en", "de"][i % 2], "c") for i in range(40)]
    rows += [(100, None, "en", "c"), (101, "", "en", "c"), (102, "1234 !?", "de", "c"), (103, "the dog", None, None), (None, "und die", "de", "c"), (4, rows[4][1], "en", "c"), (104, "the cat " * 200000, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _x string")
    got = {r["doc_id"]: r for r in predict_languages(docs).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, 104, None)] == ["und", "und", "und", "en", "en", "de"]
    nothing = docs.where("lang = 'xx'")
    assert predict_languages(nothing).count() == 0
    assert {r["lang"] for r in identify(docs, fit_languages(nothing)).collect()} == {"und"}


def test_quality_held_out(spark):
    got = op9_quality(spark, SF_DIR).collect()
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF_DIR}/labels.parquet'").fetchall())
    held = [(r["score"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    good, bad = ([s for s, y in held if y == v] for v in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.9, area
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_flat_trees_agree_with_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    made = fit_trees(x, y, trees=30)
    assert ((made.score(x) >= 0.5) == y).mean() > 0.95
    for row, got in zip(x[:50], made.score(x[:50]), strict=True):
        total = made.base
        for f, t, v in zip(made.feature, made.threshold, made.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality_hard_cases(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, " \n ", "c"), (4, "word " * 200000, "c"), (4, "word " * 200000, "c"), (None, "x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert score_quality(docs.where("doc_id < 0"), labels).count() == 0
    assert len(statistics(b"a b")) == len(FEATURES)


def test_a_language_not_learned_is_rejected_and_short_texts_stay(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("text IS NOT NULL AND lang IS NOT NULL")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    for left_out in langs[:2]:
        model = fit_languages(docs.where(F.col("lang") != left_out))
        far = identify(docs.where((F.col("lang") == left_out) & (F.length("text") > 200)), model).collect()
        assert np.mean([r["rejected"] for r in far]) > 0.9, left_out
    words = docs.where("doc_id % 4 = 2").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 12), " ").alias("text"), "lang")
    # running text only: lists of made-up words between bars, and texts strewn with signs, are not clean
    short = identify(words.where("length(text) > 40 AND NOT text RLIKE '[|%$*#=]'"), fit_languages(docs.where("doc_id % 4 <> 2"))).collect()
    assert np.mean([r["rejected"] for r in short]) == 0


def plain_counts(text):
    """Pairs and triples of bytes, a dictionary of hashed dimensions."""
    out, b = {}, text.encode().lower()
    for i in range(len(b) - 1):
        grams = [(1 << 24) + (b[i] << 8) + b[i + 1]]
        if i + 2 < len(b):
            grams.append((b[i] << 16) + (b[i + 1] << 8) + b[i + 2])
        for g in grams:
            d = (g * 0x9E3779B1 & 0xFFFFFFFF) >> 19
            out[d] = out.get(d, 0) + 1
    return out


def test_language_agrees_with_plain_tf_idf_and_cosine(spark):
    from math import exp, log, sqrt
    en, de = ["the cat sat on the mat", "a dog and the house", "this is his other hat"], ["der hund und die katze", "das ist ein haus", "wir gehen nach hause"]
    rows = [(i, f"{own[i % 3]} {i % 7}", lang) for i in range(60) for own, lang in ((en, "en"), (de, "de"))]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(train)
    counted = [plain_counts(t) for _, t, _ in rows]
    df = {}
    for c in counted:
        for d in c:
            df[d] = df.get(d, 0) + 1
    idf = {d: log((1 + len(rows)) / (1 + n)) + 1 for d, n in df.items()}
    assert all(abs(model.idf[d] - x) < 1e-4 for d, x in idf.items())
    asked = ["the house and the dog", "die katze ist im haus", "xyz qqq", "THE MAT", "7", "", "ein hat"]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    unseen = log(1 + len(rows)) + 1
    for i, text in enumerate(asked):
        counts = plain_counts(text)
        vector = {d: log(1 + n) * idf.get(d, unseen) for d, n in counts.items()}
        size = sqrt(sum(x * x for x in vector.values())) or 1
        cos = [sum(x / size * float(c[d]) for d, x in vector.items()) for c in model.centroids]
        if not any(ch.isalpha() for ch in text):
            assert (got[i]["lang"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        best = max(range(len(cos)), key=lambda j: cos[j])
        by_lang = {name: max(x for x, of in zip(cos, model.of, strict=True) if of == k) for k, name in enumerate(model.langs)}
        top = max(by_lang.values())
        assert got[i]["lang"] == model.langs[model.of[best]]
        assert abs(got[i]["score"] - 1 / sum(exp(25 * (x - top)) for x in by_lang.values())) < 1e-3
        assert got[i]["rejected"] == (cos[best] < model.least[best] * sqrt(min(1, len(counts) / model.usual[best])))


def test_every_split_is_the_best_one():
    """Each tree's splits against the gain of every feature and threshold, row by row."""
    from shelfspark.llm.quality_model import L2, LEAST_ROWS, RATE
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(160, 3)), 1)
    y = ((x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=160)) > 0).astype(float)
    made = fit_trees(x, y, trees=3, depth=2, bins=8)
    raw = np.full(len(y), made.base)
    for f, t, v in zip(made.feature, made.threshold, made.value, strict=True):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), int)
        for q in (0, 1, 2):
            if q == 1:
                node = 1 + (x[:, f[0]] > t[0])
            rows = np.flatnonzero(node == q) if q else np.arange(len(y))
            gain = lambda r: sum(g[r]) ** 2 / (sum(h[r]) + L2)
            best = 0.0
            for j in range(3):
                for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1])):
                    low, high = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if min(len(low), len(high)) >= LEAST_ROWS:
                        best = max(best, gain(low) + gain(high) - gain(rows))
            if np.isinf(t[q]):
                assert best < 1e-6
            else:
                low, high = rows[x[rows, f[q]] <= t[q]], rows[x[rows, f[q]] > t[q]]
                assert abs(gain(low) + gain(high) - gain(rows) - best) < 1e-9
        leaf = np.array([2 * (n - 1) + (x[i, f[n]] > t[n]) for i, n in enumerate(node)], int)
        for k in range(4):
            own = leaf == k
            assert abs(v[k] - RATE * g[own].sum() / (h[own].sum() + L2)) < 1e-12
        raw += v[leaf]
