import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from legajo.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SPECIALS = ["<|startoftext|>", "<|endoftext|>", "<|endof", "text|>"]
PIECES = st.sampled_from([
    " ", "\n", "\x85", "\xa0", "　", "\x1c", "\x1e", "ab", "ABC", "don't", "'s", "'", "''", "!!'", "12", "é", "e", "́", "ᄀ", "ᅡ", "ᆨ", "漢字", "İ", "ΑΣ", "🙂",
    "\x00", "_", *SPECIALS, "hello", "internationalisation", "aaaaaaaa",
])


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_words(text):
    ids = bpe.coder(PATH).encode([text])[0]
    assert (ids.tolist(), bpe.coder(PATH).decode(ids)) == library(text)


def test_white_space_of_every_character():
    chars = [chr(c) for c in [*range(0x20), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    texts = [t for c in chars for t in (f"a{c}b", f"a {c} b", c, f"{c}a")]
    assert [x.tolist() for x in bpe.coder(PATH).encode(texts)] == [library(t)[0] for t in texts]


def tree(text, leaf):
    parts = [bpe.coder(PATH).part(p) for p in bpe.cuts(text, leaf)]
    while len(parts) > 1:
        parts = [bpe.joined(bpe.coder(PATH), *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].ids.tolist() if parts else []


@pytest.mark.parametrize("window", [1, 3, 64])
@pytest.mark.parametrize("leaf", [1, 5, 17])
def test_tree_of_mixed_text(monkeypatch, window, leaf):
    monkeypatch.setattr(bpe, "WINDOW", window)

    @settings(max_examples=60, deadline=None)
    @given(st.lists(PIECES, max_size=25).map("".join))
    def check(text):
        if len(text) > leaf or not text:
            assert tree(text, leaf) == library(text)[0]

    check()


@pytest.mark.parametrize("alphabet", ["ab", "aeiounrst", "théion", "!?.'", "0123456789", "漢字かな"])
def test_tree_of_unsplit_text(alphabet):
    rnd = random.Random(8)
    for size, leaf in ((300, 16), (3000, 200), (5000, 1024)):
        text = "".join(rnd.choices(alphabet, k=size))
        assert tree(text, leaf) == library(text)[0]
    text = "abcab" * 700
    assert tree(text, 333) == library(text)[0]


def test_documents(spark):
    rnd = random.Random(3)
    rows = [
        (1, "Hello there, it's 12 o'clock"), (2, None), (3, ""), (4, "<|endoftext|> and <|startoftext|>x"), (5, "wort" * 400),
        (6, "".join(rnd.choices("etaoin ", k=2000))), (7, "é" * 333), (None, "no id " * 60), (1, "Hello there, it's 12 o'clock"), (6, "other text" * 50),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = bpe.decoded(bpe.encoded(docs, PATH, leaf=100), PATH).collect()
    want = [(i, *library(t or "")) for i, t in rows]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == sorted(want, key=str)


def test_decode_nulls_and_clashing_names(spark):
    frame = spark.createDataFrame([(None, "a"), ([49407, 320], "b"), ([], "c")], "ids array<int>, decoded string")
    got = {r.decoded for r in bpe.decoded(frame, PATH).collect()}
    assert got == {None, LIBRARY.decode([49407, 320], skip_special_tokens=False), ""}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encoded(docs, PATH).collect() == []


def test_decoding_takes_no_second_worker(spark):
    """A Python worker each for encoding and decoding, both with the tokenizer, took an executor over its memory."""
    texts = ["Hello  world\n", "[UNK] 日本 Ünïcode \\x01 \x1c $1", "", None, "same same"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = bpe.decoded(bpe.encoded(docs, PATH), PATH)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "split(" not in plan  # the list of tokens is a constant
    assert [(r.ids, r.decoded) for r in found.orderBy("doc_id").collect()] == [library(t or "") for t in texts]
    every = bpe.coder(PATH).tokens
    ids = spark.createDataFrame([(list(range(len(every))),), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decoded(ids, PATH).collect()] == [" ".join(every), "", None]
