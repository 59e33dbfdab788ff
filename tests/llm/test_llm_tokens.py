"""Token files against the tokenizer itself, and random access to sequences."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from shelfspark.llm import token_files
from shelfspark.llm.token_files import Encoder, TokenFile, read_tokens, token_folder, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a b", " lead", "trail ", "a  b", "a \n b", "tab\t x", "x\n\ny z", "ü ñ　 w", "nbsp\xa0 a \xa0b", "a <|endoftext|> b",
         "don't we'll", "  ", " ", "\n", "1 2 3,4", "a\x1c b \x1fc", "é x", "😀 😀", "word " * 3000, "a\x85 b"]


def test_pieces_give_the_ids_of_the_whole_text():
    plain = Tokenizer.from_file(PATH)
    encoder = Encoder(PATH)
    for _ in range(2):
        for text, run in zip(TEXTS, encoder.encode(TEXTS), strict=True):
            assert np.frombuffer(run, encoder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_round_trip_with_nulls_ties_and_small_sequences(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(3, "tie b", "c"), (3, "tie a", "c"), (50, None, None), (None, "no id", "c"), (5, TEXTS[5], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    parts = write_tokens(docs, token_folder(docs), PATH, length=16)
    got = {(r["start"]): r for r in read_tokens(parts).collect()}
    plain, start = Tokenizer.from_file(PATH), 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert tuple(got[start]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)
    for part in parts.collect():
        file = TokenFile(part["stem"])
        whole = np.concatenate(list(file.run(0, part["n_ids"])))
        last = (part["n_ids"] - 1) // 16
        for i in (0, last // 2, last):
            ids, mask = file.sequence(i)
            assert ids.tolist()[:mask.to_pylist().count(True)] == whole[16 * i:16 * i + 16].tolist()
            assert not ids.flags.owndata


def test_runs_over_many_batches(tmp_path, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 2)
    writer = token_files._PartWriter(str(tmp_path / "p"), np.dtype("<u2"), 4, pa.int64())
    sizes = [7, 30, 1, 3, 17]
    ids = np.arange(sum(sizes)).astype("<u2")
    ends = np.cumsum(sizes)
    for e, n in zip(ends, sizes, strict=True):
        writer.add(pa.array([int(e)]), [ids[e - n:e].tobytes()])
    writer.close()
    file = TokenFile(str(tmp_path / "p"))
    for e, n in zip(ends, sizes, strict=True):
        assert np.concatenate(list(file.run(int(e - n), n))).tolist() == ids[e - n:e].tolist()


def test_no_rows_no_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_tokens(write_tokens(docs, token_folder(docs), PATH)).count() == 0


def test_a_distinct_piece_is_looked_up_once_a_group():
    """Batches are put together, and each distinct piece of a group asks the memory once."""
    class Asked(dict):
        n = 0

        def get(self, key, other=None):
            Asked.n += 1
            return super().get(key, other)

    encoder = Encoder(PATH)
    encoder.known = Asked()
    rows = pa.record_batch({"text": ["one two three two", "two three four"]})
    groups = list(token_files._together(iter([rows, rows.slice(0, 0), rows])))
    assert [g.num_rows for g in groups] == [4]
    assert list(token_files._together(iter([]))) == []
    plain = Tokenizer.from_file(PATH)
    texts = groups[0].column("text").to_pylist()
    for text, run in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(run, encoder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert Asked.n == 3  # two, three, four; the first word of a text has no space before it


def test_odd_pieces_are_those_with_white_space_at_an_end():
    pieces = ["", "a", "\n", "a\n", "\xa0a", "é", "a\x1c", "\x7f", "x é", " "]
    found = token_files._odd(pa.array(["skipped", *pieces], pa.large_string())[1:], pieces)
    assert found.tolist() == [not x or x[0].isspace() or x[-1].isspace() for x in pieces]
    assert token_files._odd(pa.array([""], pa.large_string()), [""]).tolist() == [True]
