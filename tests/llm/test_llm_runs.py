"""Periodic runs against every period tried at every place."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import periodic_runs as module
from shelfspark.llm.periodic_runs import find_runs, periodic_runs
from shelfspark.llm.queries import periodic_rewrite


def plain_runs(words, fewest=6, times=4):
    """For each period, maximal stretches of equal words a period apart; of one stretch the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        x = 0
        while x + q < n:
            y = x
            while y + q < n and words[y] == words[y + q]:
                y += 1
            length = y - x + q
            if y > x and length >= max(fewest, times * q):
                best.setdefault((x, length), q)
            x = y + 1
    return sorted((s, n, q) for (s, n), q in best.items())


@given(st.lists(st.integers(0, 2), max_size=70))
@settings(max_examples=300, deadline=None)
def test_few_letters(words):
    assert find_runs(np.array(words, np.int64)).tolist() == [list(r) for r in sorted(plain_runs(words), key=lambda r: (r[0], r[2]))]


def test_planted_periods_of_all_sizes():
    draw = random.Random(5)
    for _ in range(150):
        period, copies = draw.randint(1, 60), draw.uniform(3, 9)
        block = [draw.randint(0, 5) for _ in range(period)]
        middle = (block * 10)[:int(period * copies)]
        words = [draw.randint(0, 9) for _ in range(draw.randint(0, 50))] + middle + [draw.randint(0, 9) for _ in range(draw.randint(0, 50))]
        assert [tuple(r) for r in find_runs(np.array(words)).tolist()] == plain_runs(words)


def test_one_word_over_and_over():
    assert find_runs(np.zeros(5000, np.int64)).tolist() == [[0, 5000, 1]]
    assert find_runs(np.zeros(5, np.int64)).tolist() == []
    assert find_runs(np.arange(5000)).tolist() == []


def test_words_decide_where_fingerprints_do_not(monkeypatch):
    monkeypatch.setattr(module, "BASES", (1, *module.BASES))  # base 1: every order of the same words looks alike
    words = [1, 2, 2, 1, 1, 2, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1]
    assert [tuple(r) for r in find_runs(np.array(words)).tolist()] == plain_runs(words)


TEXTS = [None, "", " \t\n ", "a", "a a a a a", "x a a a a a a y", "a b a b a b a b c", "é é é é é é é", "a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca",
         "p q r s " * 9 + "end", "a b c " * 5 + "a b a b a b a b", "no run here at all"]


def expected(doc_id, text, rewrite=None):
    words = (text or "").encode().split()
    if rewrite:
        words = rewrite(doc_id, words)
    runs = plain_runs(words)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(runs), start, length, period, 1000 * length // period if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_rows_with_nulls_repeats_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(module, "PART_BYTES", 40)
    rows = [(i, t, "c", i) for i, t in enumerate(TEXTS)] + [(3, "a", "c", 0), (None, "b b b b b b b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = periodic_runs(docs).collect()
    assert sorted(map(str, (tuple(r)[:8] for r in got))) == sorted(str(expected(r[0], r[1])) for r in rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5]["collapsed"] == "x a y" and [tuple(x) for x in by_id[5]["runs"]] == [(1, 6, 1)]
    empty = periodic_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and "collapsed" in empty.columns


def test_long_text_and_the_query_rule(spark):
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randint(0, 400)}" for _ in range(draw.choice([0, 1, 3, 40, 300]))) for _ in range(400)]
    texts[7] = "lorem ipsum " * 60_000 + "dolor"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in periodic_runs(docs, rewrite=periodic_rewrite, texts=False).collect()}
    assert (got[7][1:5] == (1, 0, 120_000, 2)) or periodic_rewrite(7, texts[7].encode().split()) != texts[7].encode().split()
    for i, t in enumerate(texts):
        if i != 7:
            assert got[i] == expected(i, t, periodic_rewrite)
    assert sum(got[i][1] > 0 for i in got if i != 7) >= 3
