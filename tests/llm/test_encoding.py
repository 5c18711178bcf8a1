"""The cached encoder against the library: what it cuts a piece into, and how often it looks a piece up."""

from __future__ import annotations

from array import array

import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weftline.llm import token_files, tokens

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
LINES = [
    "one.\ntwo three,\nFour! five\nsix seven\n\neight nine.\n\nten eleven\n twelve",
    "\nfirst\nsecond .\nthird fourth.\n5 6\nsixth seventh\r\neighth it's\nit's x\ny\nz",
    "İstanbul. İ\nmir aİbİ.\ncİ ǅep ȺaȾ ẞ été.\nÉTÉ ×a÷ Å",
    "tabs\tand \x0b spaces  　 wide  two   three \n x",
    "word" * 20 + " a" * 3 + " " + "b" * 48 + ".\nc " + "d" * 49 + ".",
    "a <|endoftext|> b <|startoftext|>.\nc",
    "", " ", "\n", "  ", "a", " a", "a ",
]


@pytest.mark.parametrize("name", NAMES)
def test_line_ends_and_capitals_as_the_library(name):
    t, encode = Tokenizer.from_file(P.path(name)), tokens.PieceEncoder(P.path(name), tokens.as_bytes, b"".join, key="lines")
    for texts in (LINES, LINES[::-1], ["x " + a for a in LINES], []):
        assert [list(array("I", ids)) for ids in encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    count = tokens.PieceEncoder(P.path(name), tokens.as_length, sum, key="lines")
    assert count(LINES) == [len(t.encode(x, add_special_tokens=False).ids) for x in LINES]


@pytest.mark.parametrize("name", NAMES)
def test_words_on_both_sides_of_a_line_end_are_met_alone(name):
    """Every pair of words is a new piece, but no new word: the library is not called for it."""
    encode = tokens.PieceEncoder(P.path(name), tokens.as_bytes, b"".join, key="pairs")
    words = [a + b for a in ("ka", "lo", "mi") for b in ("ran", "tel", "sun")]
    encode([" ".join(["x", *words, *words, *(f"x.\n{w}," for w in words)])])
    encode.tokenizer = encode.bare = None
    assert all(encode([f"x {a}.\n{b}," for a in words for b in words]))


def test_each_piece_of_many_texts_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

        def __getitem__(self, p):
            Counted.asked += 1
            return super().__getitem__(p)

    encode = tokens.PieceEncoder(P.path("word_bpe_49k.json"), tokens.as_bytes, b"".join, key="once")
    encode(["of the same few words"])
    encode.tail = Counted(encode.tail)
    first, *others = encode(["of the same few words"] * 500)
    assert set(others) == {first} and Counted.asked == 4


def test_batches_are_put_together_whole(monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_CHARS", 10)
    texts = ["abc", "", "defgh", "x" * 30, "y", "z"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts)]
    found = list(token_files.many(iter(batches)))
    assert [d for docs, _ in found for d in docs] == list(range(6)) and [t for _, ts in found for t in ts] == texts
    assert [len(docs) for docs, _ in found] == [4, 2] and list(token_files.many(iter([]))) == []


def test_packed_words_hold_any_code():
    import numpy as np

    codes = np.random.default_rng(3).integers(0, 1 << 60, 4000, dtype=np.uint64) >> np.random.default_rng(4).integers(0, 60, 4000).astype(np.uint64)
    codes = np.concatenate((codes, np.array([0, 1, (1 << 30) - 1, 1 << 30, (1 << 32) - 1, 1 << 32, (1 << 60) - 1], np.uint64)))
    for some in (codes, np.sort(codes), codes[:0], codes[:1]):
        assert np.array_equal(token_files.unpack_words(token_files.pack_words(some)), some)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_missing_pieces_are_worked_on_a_few_at_a_time(monkeypatch, name):
    texts = [f"Word{i} one, two{i}\nthree 4{i} " + "x" * (i % 60) for i in range(200)]
    whole = tokens.PieceEncoder(P.path(name), tokens.as_bytes, b"".join, key="whole")(texts)
    most, add = [], tokens.PieceEncoder._add_some
    monkeypatch.setattr(tokens, "ADDED", 16)
    monkeypatch.setattr(tokens.PieceEncoder, "_add_some", lambda self, cache, new, prefix: (most.append(len(new)), add(self, cache, new, prefix))[1])
    few = tokens.PieceEncoder(P.path(name), tokens.as_bytes, b"".join, key="few")
    assert few(texts) == whole and max(most) <= 16
    assert not any(len(p) > tokens.CACHE_CHARS for p in [*few.head, *few.tail])


def test_many_token_files_take_one_table_file_and_few_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of many") for i in range(400)], "doc_id long, text string")
    listed = token_files.write(docs, str(tmp_path), P.path("word_bpe_49k.json"), files=40)
    assert listed.count() == 40 and len(list((tmp_path / "_list").glob("*.parquet"))) == 1
    found = token_files.read(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    rows = sorted(found.collect())
    assert [r.doc_id for r in rows] == list(range(400)) and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(400)]
    assert token_files.FILE_PIECES < tokens.CACHE_PIECES
