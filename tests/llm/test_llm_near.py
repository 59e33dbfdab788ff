"""Near-dedup against all pairs, components against a plain search."""

import random
from collections import defaultdict

import numpy as np
import pytest

from shelfspark.llm import near_dedup
from shelfspark.llm.components import components
from shelfspark.llm.near_dedup import near_duplicates, signature
from shelfspark.llm.shingles import shingle_set, word_hashes


def plain_set(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def roots_of(nodes, links):
    near, root = defaultdict(set), {}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for n in sorted(nodes):
        if n not in root:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = n
                    todo += near[x]
    return root


def brute(rows, k):
    sets = {d: plain_set(t, k) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots_of(sets, links)
    return sorted((d, len(sets[d]), root[d], root[d] == d) for d in sets)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("k", [2, 5])
def test_groups_chains_and_stars(spark, k):
    rng = random.Random(k)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(120)]
        last = base
        for i in range(rng.choice([1, 2, 5, 60])):
            text = edited(rng, last if g % 2 else base, rng.randrange(0, 7 if k == 2 else 3))
            last = text.split(" ") if g % 2 else last  # chains, or stars around one text
            rows.append(text)
    rows += ["", " \n", "one", "One", "one two", "a b c d", "A  b\tc d", "x " * 30000]
    rng.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)] + [(1, None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, id string")
    got = sorted(tuple(r) for r in near_duplicates(df, k=k).collect())
    assert got == brute(rows, k)


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (7, "other words are here now"), (9, "other words are here now"), (None, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df, k=2).collect()), key=str)
    assert [(r[0], r[2], r[3]) for r in got] == [(5, 5, True)] * 2 + [(7, 5, False)] * 2 + [(9, 5, False)] + [(None, None, True)] * 2
    assert near_duplicates(df.where("doc_id < 0")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 600 + i) for i in range(300)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == roots_of(nodes, edges)


def test_words_of_long_texts_do_not_depend_on_the_cut():
    text = " ".join(f"word{i % 977}" for i in range(400_000)).encode()
    whole = word_hashes(text)
    assert len(whole) == 400_000
    assert (whole[:977] == whole[977:1954]).all() and len(np.unique(whole)) == 977
    assert len(shingle_set(b"a B", 5)) == 1 and len(shingle_set(b"", 2)) == 0
    assert len(signature(shingle_set(text, 2))) == 128


def test_pairs_inside_a_template_crowd(spark):
    # all texts share 870 words: 0.769 to each other; 2i and 2i + 1 share 26 more: 0.811
    shared = [f"t{i}" for i in range(870)]
    rows = [(d, " ".join(shared + [f"p{d // 2}x{i}" for i in range(26)] + [f"d{d}x{i}" for i in range(104)])) for d in range(1600)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}


@pytest.mark.parametrize("partitions", [8, 400])
def test_a_star_does_not_depend_on_the_number_of_partitions(spark, monkeypatch, partitions):
    # each edit changes 11 % of the base: 0.802 to it, about 0.65 to each other
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for d in range(1, 1001):
        words = list(base)
        for i in rng.sample(range(200), 22):
            words[i] = f"e{d}x{i}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = near_dedup.candidates

    def cut(trees):  # only the orders are cut so small
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            return whole(trees)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    monkeypatch.setattr(near_dedup, "candidates", cut)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df, k=1).collect()} == {d: 0 for d, _ in rows}
