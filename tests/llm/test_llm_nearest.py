"""Nearest neighbours against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import nearest
from shelfspark.llm.nearest import code_vectors, search


def brute(rows, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            cos = [(-float(np.clip(np.dot(q, v) / np.sqrt(np.dot(q, q) * np.dot(v, v)), -1, 1)), j) for j, v in good if j != i and len(v) == len(q)]
            out[i] = sorted((round(c, 12), j) for c, j in cos)[:k]
    return out


def answered(spark, rows, k=5, kind="double"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank string, score int").repartition(3)
    got = search(code_vectors(table), table.where(F.col("vec_id") % 50 == 0), k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((round(-r["score"], 12), r["vec_id"]))
    return out


def clusters(n, dims, seed):
    draw = np.random.default_rng(seed)
    hot = draw.standard_normal(dims)
    out = []
    for i in range(n):
        v = hot + 0.05 * draw.standard_normal(dims) if i % 3 == 0 else draw.standard_normal(dims)
        out.append((i, v.tolist()))
    return out


@pytest.mark.parametrize("dims", [3, 64, 300])
def test_recall_with_a_hot_cluster(spark, dims, monkeypatch):
    monkeypatch.setattr(nearest, "HELD", 1 << 14)
    rows = clusters(2000, dims, dims)
    want, got = brute(rows), answered(spark, [(*r, "c", 1) for r in rows])
    hits = sum(len(set(map(tuple, want[q])) & set(got[q])) for q in want)
    assert len(got) == len(want) == 40
    assert hits >= 0.99 * 5 * len(want)


def test_bounds_choose_few_rows():
    import pyarrow as pa
    rows = clusters(4000, 64, 1)
    vectors = np.array([v for _, v in rows])
    centres = nearest._centres(nearest._units(vectors[:1000]))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(vectors.tolist())], ["vec_id", "vector"])
    held = nearest._Held(pa.Table.from_batches([nearest._coded(batch, 64, centres)]), 64, centres)
    asked, plain = [], held.exact
    held.exact = lambda q, s, r: asked.append(len(r)) or plain(q, s, r)
    assert len(list(held.nearest(np.arange(0, 4000, 50), vectors[::50], 5, True))) == 80
    assert sum(asked) < 0.25 * 80 * 4000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0]), (3, [-1.0, 0.0]), (4, [1e200, 1e200]), (5, [1e-200, 0.0]),
            (6, None), (7, []), (8, [0.0, 0.0]), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [None, 1.0]), (None, [1.0, 0.0]),
            (100, None), (150, [0.0, 0.0]), (200, [1.0, 2.0, 3.0]), (12, [1.0, 2.0, 3.5]), (2, [5.0, 0.0])]
    got = answered(spark, [(*r, "c", 1) for r in rows], k=4)
    assert got[0] == [(-1.0, 1), (-1.0, 2), (-1.0, 2), (-1.0, 5)]
    assert got[50] == [(round(-0.5 ** 0.5, 12), 4), (0.0, 0), (0.0, 1), (0.0, 2)]
    assert [j for _, j in got[200]] == [12]  # all candidates of its size
    assert sorted(got) == [0, 50, 200]


def test_ties_repeats_and_many_equal_vectors(spark):
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(120, 0, -1)] + [(0, [0.0, 0.0, 1.0])]
    got = answered(spark, [(*r, "c", 1) for r in rows], kind="float")
    assert got[50] == [(-1.0, i) for i in (1, 2, 3, 4, 5)] and got[100] == got[50]
    assert got[0] == [(0.0, i) for i in (1, 2, 3, 4, 5)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert search(code_vectors(none), none).count() == 0
    assert search(code_vectors(some), none).count() == 0
    assert search(code_vectors(none), some).count() == 0
