"""Substring dedup against a plain search; suffix order against plain sorting."""

import hashlib
import random
import time

import numpy as np
import pytest

from shelfspark.llm import substring_dedup
from shelfspark.llm.substring_dedup import GRAM, anchors, dedup_substrings
from shelfspark.llm.suffix_groups import sort_suffixes


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(150):
        texts = [np.append(rng.integers(1, rng.choice([2, 3, 4, 21]), rng.integers(0, 60)), 0) for _ in range(rng.integers(1, 8))]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = sort_suffixes(np.concatenate(texts), bounds)
        for t, a in zip(texts, bounds[:-1], strict=True):
            s = t.tolist()
            assert (got[a:a + len(s)] - a).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, length):
    first = {}
    for d, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - length + 1):
            if d is not None:
                g = t[i:i + length]
                first[g] = min(d, first.get(g, d))
    out = []
    for d, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if d is not None and first[t[i:i + length]] < d:
                gone[i:i + length] = 1
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 3])
def test_against_plain_search(spark, block):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdefgh ü") for _ in range(rng.randrange(45, 200))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randrange(9):] if rng.random() < 0.5 else "".join(rng.choice("abc é") for _ in range(rng.randrange(120))) for _ in range(rng.randrange(5))]
        rows.append((rng.randrange(1000), "".join(parts)))
    rows = list(dict(rows).items()) + [(2000, None), (2001, ""), (2002, "a" * 3000), (2003, "a" * 49), (2004, "a" * 51), (2005, "ab" * 700), (2006, "b" + "ab" * 30)]
    rows += [rows[3], rows[3], (None, rows[4][1] + passages[0]), (2007, rows[5][1]), (2007, rows[6][1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, h string")
    got = dedup_substrings(df, block=block).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 50)
    assert dedup_substrings(df.where("doc_id < 0")).count() == 0


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    text = bytes(random.Random(2).choices(b"abcd", k=5000)) + b"a" * 300
    whole = anchors(text)
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    cut = anchors(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_no_shuffle_files_are_left(spark):
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    rng = random.Random(3)
    common = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(40)) + common[i % 7:]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffles()
    assert dedup_substrings(df).where("n_removed > 0").count() == 39
    for _ in range(50):  # Spark takes them away beside the next work
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before


def test_pieces_keep_what_contexts_share():
    """What is sorted of the contexts gives the ids that sorting all of them gives."""
    rng = random.Random(4)
    for length in (31, 50):
        for letters in (b"ab", b"abcdefgh", b"\xfe\xff\x00"):
            crowds: dict[int, dict[bytes, int]] = {}
            base = [bytes(rng.choices(letters, k=rng.randrange(1, 90))) * rng.choice([1, 1, 4, 30]) for _ in range(5)]
            for doc_id in range(25):
                text = b"".join(rng.choice(base)[rng.randrange(4):][:rng.randrange(20, 200)] for _ in range(rng.randrange(1, 5)))
                for p, h in zip(*(x.tolist() for x in anchors(text, length)), strict=True):
                    context = text[max(0, p - length + GRAM):min(p, len(text) - length) + length]
                    crowd = crowds.setdefault(h, {})
                    crowd[context] = min(doc_id, crowd.get(context, doc_id))
            several = {h: c for h, c in crowds.items() if len(c) > 1}
            blocks = [list(c.items()) for c in several.values()]
            hashes = np.array([h for h, c in several.items() for _ in c], np.uint64).view(np.int64).tolist()
            plain = [x for own in substring_dedup._sort_blocks(blocks, length) for x in own]
            got = substring_dedup._least_ids(blocks, hashes, length)
            assert [x.tolist() for x in got] == [x.tolist() for x in plain]


def test_hashes_that_occur_again_are_in_the_filter(spark):
    rng = np.random.default_rng(6)
    once, twice = rng.integers(-(1 << 62), 1 << 62, 3000), rng.integers(-(1 << 62), 1 << 62, 500)
    rows = spark.createDataFrame([(int(h),) for h in (*once, *twice, *twice, 0, 0)], "h long").repartition(5)

    def hashes(batch):
        yield batch.column("h").to_numpy().view(np.uint64)

    for bits in (1 << 10, 1 << 15, 1 << 28):
        found = substring_dedup.repeated_cells(rows, hashes, bits)
        assert found.has(np.append(twice, 0).view(np.uint64)).all()
        cells = {int(h) % bits for h in twice} | {0}
        assert found.has(once.view(np.uint64)).sum() == sum(int(h) % bits in cells for h in once)


def test_places_travel_packed(spark, monkeypatch):
    """No table between the steps has a row for each place, also where an anchor has more contexts than a block."""
    rng = random.Random(7)
    common = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(6)]
    line = "".join(rng.choice("abcdefgh ") for _ in range(44))
    rows = [(i, " ".join([*rng.sample(common, 3), "".join(rng.choice("ab") for _ in range(9)), line, "".join(rng.choice("ab") for _ in range(9))])) for i in range(400)]
    n, kept = [], substring_dedup.stored

    def counted(df):
        n.append((made := kept(df)).count())
        return made
    monkeypatch.setattr(substring_dedup, "stored", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = dedup_substrings(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 50)
    places = sum(len(anchors(t.encode())[0]) for _, t in rows)
    assert places > 30_000 and max(n) < places / 4


def test_a_text_of_several_pieces(spark):
    text = random.Random(8).randbytes(2 * substring_dedup.PIECE // 3).hex()
    df = spark.createDataFrame([(1, text), (2, "x" * 60 + text), (3, text[-70:])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in dedup_substrings(df).collect()}
    assert len(text) > substring_dedup.PIECE and got == {1: (0, 0), 2: (len(text), 1), 3: (70, 1)}


def test_stretches_that_strings_link_are_sorted_together():
    keys, owner = np.array([5, 6, 6, 7, 9, 9, 5, 8], np.uint64), np.array([0, 0, 1, 2, 3, 4, 5, 6])
    assert substring_dedup._linked(keys, owner, 7).tolist() == [0, 0, 2, 3, 3, 0, 6]
    chain = np.repeat(np.arange(40, dtype=np.uint64), 2)[1:-1]
    assert not substring_dedup._linked(chain, np.repeat(np.arange(39), 2), 39).any()
