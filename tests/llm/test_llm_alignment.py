"""Token alignment against both tokenizers run on whole texts and every pair of tokens compared."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfspark.llm import token_alignment as module
from shelfspark.llm.token_alignment import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", " lead", "trail ", "two  blanks", "a\nb c\n\n d", "tab\tx y", "x\xa0y z", "a ▁b c", "é ñ 日本 語", "😀 👍🏽 ok",
         "a <|endoftext|> b", "<s> </s> <0x41> <unk>", "a\x00b \x01", "the the the the cat", "e\u0301 a\u200b b\u3000c", "\r\n x", "a " * 40, "antidisestablishmentarianism " * 3,
         "x" * 300 + " y", "the cat sat", "Ünïcödé wörds here", "fi ﬁ ａ"]


def byte_letters():
    """The letter of each byte in byte-level vocabularies: printable ones are themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a.encode_special_tokens = True
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        whole = (" " + text).encode()
        ta = a.encode(" " + text, add_special_tokens=False)
        tb = b.encode(text)
        ba = [bytes(letters[c] for c in t) for t in ta.tokens]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in tb]
        if b"".join(ba) != whole or b"".join(bb) != whole:
            out.append(None)
            continue
        def ends(pieces):
            at, found = 0, []
            for p in pieces:
                at += len(p)
                found.append(at)
            return found
        ea, eb = ends(ba), ends(bb)
        links = [(x, y) for x, i in zip(ta.ids, ea, strict=True) for y, j in zip(tb, eb, strict=True) if i == j]
        groups, last = [], 0
        for cut in sorted(set(ea) & set(eb)):
            groups.append(",".join(str(x) for x, i in zip(ta.ids, ea, strict=True) if last < i <= cut) + "|" + ",".join(str(y) for y, j in zip(tb, eb, strict=True) if last < j <= cut))
            last = cut
        out.append((len(ta.ids), len(tb), ";".join(groups), links))
    counts = Counter(link for x in out if x for link in x[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for x in out:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            rows.append((x[0], x[1], x[2].count(";") + 1, len(x[3]), sum(counts[k] == best[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), hashlib.sha256(x[2].encode()).hexdigest()))
    docs = Counter(k for x in out if x for k in set(x[3]))
    return rows, {(*k, docs[k], n, n == best[k[1]]) for k, n in counts.items()}


@pytest.mark.parametrize("links", [1 << 20, 40])
def test_rows_and_pairs(spark, monkeypatch, links):
    monkeypatch.setattr(module, "LINKS", links)  # many containers
    monkeypatch.setattr(module, "PART_BYTES", 200)
    draw = random.Random(2)
    words = ["the", "cat", "naïve", "don't", "1234", "x_y", "日本語", "Straße", "foo-bar", "a"]
    texts = TEXTS + [" ".join(draw.choices(words, k=draw.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string, a int").repartition(3)
    found, pairs = align(docs, A, B)
    want, want_pairs = brute(texts)
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert tuple(got[i])[1:8] == w, texts[i]
        assert hashlib.sha256(got[i]["groups"].encode()).hexdigest() == w[6] or not w[6]
    assert {tuple(r) for r in pairs.collect()} == want_pairs


def test_planes_of_frequent_pairs_and_repeated_rows(spark):
    texts = ["the " * n + "end" for n in (1, 2, 3, 4, 7, 8, 100, 257)] * 3 + ["the " * 30_000]
    ids = [*list(range(8)) * 3, None]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(1)
    found, pairs = align(docs, A, B, groups=False)
    want, want_pairs = brute_frequent(texts)
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(str((i, *w)) for i, w in zip(ids, want, strict=True))
    assert {tuple(r) for r in pairs.collect()} == want_pairs


def brute_frequent(texts):
    """The same, with offsets in a dictionary (the long text has too many pairs of tokens to try all)."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    out = []
    for text in texts:
        ia, ib = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        at, ea, eb = 0, {}, {}
        for i, t in zip(ia.ids, ia.tokens, strict=True):
            at += len(t)
            ea[at] = i
        at = 0
        for i in ib:
            at += len(b.id_to_piece(i).replace("▁", " "))
            eb[at] = i
        groups, last = [], 0
        for cut in sorted(ea.keys() & eb.keys()):
            groups.append("|".join(",".join(str(e[k]) for k in sorted(e) if last < k <= cut) if len(e) < 2000 else str(e[cut]) for e in (ea, eb)))
            last = cut
        out.append((len(ia.ids), len(ib), ";".join(groups), [(ea[k], eb[k]) for k in sorted(ea.keys() & eb.keys())]))
    counts, docs = Counter(k for x in out for k in x[3]), Counter(k for x in out for k in set(x[3]))
    best = {y: max(n for (_, z), n in counts.items() if z == y) for _, y in counts}
    rows = [(x[0], x[1], len(x[3]), len(x[3]), sum(counts[k] == best[k[1]] for k in x[3]), sum(counts[k] for k in x[3]), hashlib.sha256(x[2].encode()).hexdigest()) for x in out]
    return rows, {(*k, docs[k], n, n == best[k[1]]) for k, n in counts.items()}


def test_empty_table(spark):
    found, pairs = align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert found.count() == 0 and pairs.count() == 0
