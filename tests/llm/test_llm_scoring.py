"""Language-model scores: base counts by hand, a true distribution, better than the base, hard cases."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import mixing_lm
from shelfspark.llm.mixing_lm import Code, held_out_fifth, log_probabilities, score_texts

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def base_by_hand(rows):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for d, _ in rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    bottom = sum(counts.values()) + 0.5 * (len(counts) + 1)
    return [(h, len(ws), sum(counts[w] > 0 for w in ws), sum(counts.values()), sum(math.log10((counts[w] + 0.5) / bottom) for w in ws)) for ws, h in zip(tokens, held, strict=True)]


@pytest.mark.parametrize("codebook", [1 << 18, 50])
def test_given_documents(spark, codebook):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = sorted(score_texts(docs, held_out_fifth(), codebook).collect())
    data = pq.read_table(f"{SF_DIR}/documents.parquet").to_pydict()
    rows = sorted(zip(data["doc_id"], data["text"], strict=True))
    for r, want in zip(got, base_by_hand(rows), strict=True):
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:4]
        assert r["base_score"] == pytest.approx(want[4], rel=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] > 0
    held = [r for r in got if r["held_out"]]
    bits = -sum(r["score"] for r in held) * math.log2(10) / sum(len(t.encode()) for d, t in rows if zlib.crc32(str(d).encode()) % 5 == 1)
    assert bits < 4.5, bits


def test_hard_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "the cat sat"), (4, "the cat sat"), (None, "The CAT"), (6, "x" * 5000), (7, "the " * 20000), (8, "ü 漢字 the cat")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_tokens string")
    got = score_texts(df, held_out_fifth()).collect()
    key = lambda r: (str(r[0]), r[1])
    want = sorted(((d, w[1], *w[2:4]) for (d, _), w in zip(rows, base_by_hand(rows), strict=True)), key=key)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=key) == want
    assert score_texts(df.where("doc_id < 0"), held_out_fifth()).count() == 0
    alone = score_texts(df, F.lit(True)).collect()
    assert len(alone) == len(rows) and all(np.isfinite(r["score"]) and r["n_known"] == 0 for r in alone)


def test_probabilities_sum_to_one_and_neighbours_do_not_matter():
    code = Code([b"a", b"b", b"c"], [5, 3, 1], 2, 1, 12, 5)
    rng = np.random.default_rng(1)
    tables = mixing_lm.predictors([rng.integers(0, 9, t.shape).astype(np.float32) for t in mixing_lm._tables(code)])

    def logs(split):
        cells, bits, of, kinds, *_ = code.encode(split)
        return log_probabilities(cells, tables, bits, of, kinds, len(split))

    # all continuations of one word: the codebook, the end, and the escape (its code is a prefix of every spelling)
    some = logs([[], [b"a"], [b"b"], [b"c"]])
    first = []
    for words in ([], [b"a"], [b"b"], [b"c"], [b"zz"]):
        cells, bits, of, kinds, ids, *_ = code.encode([words])
        n = int(code.paths[1][ids[0]])
        first.append(log_probabilities([c[:n] for c in cells], tables, bits[:n], of[:n], kinds[:n], 1)[0])
    assert np.exp(first).sum() == pytest.approx(1, abs=1e-4)
    assert logs([[b"b"], [b"zz"] * 50, [b"a", b"c"] * 3000])[0] == pytest.approx(some[2])


def test_a_task_scores_much_text_in_little_memory():
    """Fails where a task makes arrays of all bits of 2 MB of text at once."""
    import tracemalloc
    words = [f"w{i}".encode() for i in range(3000)]
    code = Code(words, list(range(3000, 0, -1)), 9, 1, sum(range(3001)), 3000)
    rng = np.random.default_rng(3)
    tables = mixing_lm.predictors([rng.integers(0, 9, t.shape).astype(np.float32) for t in mixing_lm._tables(code)])
    texts = [b" ".join(words[i] for i in rng.integers(0, 3000, 4000)) for _ in range(100)]
    code.symbols()
    tracemalloc.start()
    logs = []
    for split in mixing_lm._words(texts):
        cells, bits, of, kinds, *_ = code.encode(split)
        logs += log_probabilities(cells, tables, bits, of, kinds, len(split)).tolist()
        del cells, bits, of, kinds
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(logs) == 100
    assert peak < 150e6


def test_stretches_of_kinds_and_texts():
    of, kinds = np.array([0, 0, 2, 2, 2, 0, 3], np.int32), np.array([0, 0, 0, 0, 0, 1, 1], np.int8)
    starts, sizes = mixing_lm._stretches(of, kinds)
    assert starts.tolist() == [0, 2, 5, 6]
    assert sizes.tolist() == [2, 3, 1, 1]
    assert [x.tolist() for x in mixing_lm._stretches(of[:0], kinds[:0])] == [[], []]


def test_scoring_holds_little_beside_the_tables():
    """Fails where arrays of all bits of 400 KB of text are made at once."""
    import tracemalloc
    words = [f"w{i}".encode() for i in range(3000)]
    code = Code(words, list(range(3000, 0, -1)), 9, 1, sum(range(3001)), 3000)
    rng = np.random.default_rng(3)
    tables = mixing_lm.predictors([rng.integers(0, 9, t.shape).astype(np.float32) for t in mixing_lm._tables(code)])
    texts = [b" ".join(words[i] for i in rng.integers(0, 3000, 4000)) for _ in range(30)]
    code.symbols()
    tracemalloc.start()
    for split in mixing_lm._words(texts):
        cells, bits, of, kinds, *_ = code.encode(split)
        log_probabilities(cells, tables, bits, of, kinds, len(split))
        del cells, bits, of, kinds
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36e6


def test_tasks_load_tables_as_they_were_counted(spark, monkeypatch):
    """Chunk by chunk, with the code that tasks have already."""
    texts = spark.createDataFrame([("a b a c zz",), ("b a",), (None,), ("C c c",)], "text string")
    words = mixing_lm.stored(mixing_lm.count_words(texts))
    code = mixing_lm.make_code(words, 2)
    assert (code.words, code.counts.tolist(), code.total, code.distinct) == ([b"c", b"a"], [4, 0, 4, 3], 14, 5)
    assert mixing_lm.make_code(words, 3).words == [b"c", b"a", b"b"]
    assert mixing_lm.make_code(words, 99).words == [b"c", b"a", b"b", b"zz"]
    assert mixing_lm.make_code(words.where("n < 0"), 9).words == []
    files = mixing_lm.gather_counts(texts, words, code, spark.sparkContext.broadcast(code)).inputFiles()
    plain = mixing_lm._tables(code)
    for cells, bits, *_ in (code.word_bits([[b"a", b"b", b"a", b"c", b"zz"], [b"b", b"a"], [], [b"c"] * 3])[0], code.spelling_bits([b"a", b"b", b"c", b"zz"])):
        for table, cell in zip(plain, cells, strict=True):
            np.add.at(table, (cell.astype(np.int64), bits), 1)
    monkeypatch.setattr(mixing_lm, "_held", {})
    want = mixing_lm.predictors([t.astype(np.float32) for t in plain])
    for got, own in zip(mixing_lm.load_predictors(files, code), want, strict=True):
        # (a spelling's bits depend on the word before it in no way, so the order of words is free)
        assert (got[1] == own[1]).all() and np.allclose(got[0], own[0])
