"""Exact dedup, mixing, line dedup and decontamination on small hard cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfspark.llm.decontaminate import decontaminate
from shelfspark.llm.exact_dedup import exact_duplicates
from shelfspark.llm.line_dedup import PerfectHash, dedup_lines
from shelfspark.llm.mixing import mix, source_targets

#: Nulls, empty and blank texts, ties, repeated rows, a very long text, columns with clashing names.
HARD = [
    (1, "a b\tc", "s1", "x", 1), (2, "a  b c", "s1", None, 2), (3, None, None, "y", 3), (4, "", "s2", "y", 4),
    (5, " ", "s2", "y", None), (6, "\n\n", None, "z", 6), (7, "A b c", "s1", "z", 7), (8, "a b c", "s3", "z", 8),
    (8, "a b c", "s3", "z", 8), (None, "a b c", "s3", "z", 9), (None, "alone", "s3", "z", 9), (10, "ü " * 40000, "s4", "z", 9),
]
SCHEMA = "doc_id long, text string, source string, size string, n long"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_hard_cases(hard):
    want, groups = [], defaultdict(list)
    for r in HARD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    for r in HARD:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids) if ids else None
        want.append((r[0], keep, len(groups[norm]), r[0] == keep, hashlib.sha256(norm.encode()).hexdigest()))
    for bits in (1 << 26, 64):  # 64 cells: the filter is full and lets nearly all rows through
        got = [tuple(r) for r in exact_duplicates(hard, filter_bits=bits).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark, empty):
    assert exact_duplicates(empty).count() == 0
    assert mix(empty).count() == 0
    assert dedup_lines(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(empty, items).count() == 0


def test_mixing_hard_cases(hard):
    got = mix(hard).collect()
    sizes = Counter()
    for r in HARD:
        sizes[r[2]] += len((r[1] or "").split())
    assert len(got) == len(HARD)
    assert {r["source"]: r["source_size"] for r in got} == dict(sizes)
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 for r in got)


def test_targets_reshare_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 100), ("z", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    weights = dict(zip(["a", "b", "c", "z", None], [1, 2, 3, 1, 2], strict=True))
    size = {"a": 10, "b": 1000, "c": 5, "z": 0, None: 100}
    want, left, free = {}, float(sum(size.values())), set(size)
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        free -= over
    assert got == pytest.approx(want)


def test_mixing_comes_near_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(3000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) <= 4


def brute_lines(rows, least=20, docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    holders = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if doc_id is not None and len(k) >= least:
                holders[k].append(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if doc_id is None or len(holders[key(x)]) < docs or max(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_line_dedup_against_brute_force(spark):
    line = "This very line is found in MANY texts ü"
    rows = [(i, f"own {i} {'x' * 30}\n {line.lower() if i % 2 else line}\t\nshort\n" + ("é" * 19 + "\n" + "é" * 20 + "\n") * 2) for i in range(9)]
    rows += [(20, None), (21, ""), (None, line), (22, "\n\n"), (23, line + "\n" + line), (24, "long " * 50000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_lines string")
    for keys in (500_000, 1):
        got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(df, shard_keys=keys).collect()]
        assert sorted(got, key=str) == brute_lines(rows)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    made = PerfectHash.build(keys)
    assert sorted(made.find(keys)) == list(range(len(keys)))


def test_decontaminate_spans_and_slices(spark):
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (None, "null id words")]
    text = "Intro: one, TWO three-four five six seven eight nine ten eleven! and a short   item here"
    rows = [(1, text), (2, None), (3, ""), (4, "nothing of it"), (5, "one two three four five six seven eight nine eleven"), (6, "x " * 30000 + text), (6, "x " * 30000 + text)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, words string")
    whole = decontaminate(docs, bench).orderBy("doc_id").collect()
    by = {r["doc_id"]: r for r in whole}
    assert (by[1]["n_words"], by[1]["n_hit"], by[1]["n_items"]) == (17, 13, 2)
    assert by[1]["items_sha256"] == hashlib.sha256(b"1,2").hexdigest()
    assert by[1]["clean_text"] == "Intro: ! and a  here"
    assert [by[i]["contaminated"] for i in (2, 3, 4, 5, 6)] == [False, False, False, False, True]
    assert [tuple(r) for r in decontaminate(docs, bench, max_windows=1).orderBy("doc_id").collect()] == [tuple(r) for r in whole]
