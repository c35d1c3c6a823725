import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from legajo.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN, LIBRARY = packing.Ids(PATH), Tokenizer.from_file(PATH)


PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", "　", "\x1c", "\x1f", "ab", "don't", "It's", "'s", "12", "é", "—", "<|endoftext|>", "<|endof", "漢字", "́", "\x00", "🙂", "x" * 70])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_ids_as_the_library(text):
    assert np.frombuffer(OWN.of([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_vocabularies_that_merge_otherwise_are_left_to_the_library():
    assert OWN.fast is not None
    other = public_tokenizers.path("word_bpe_49k.json")
    slow, library = packing.Ids(other), Tokenizer.from_file(other)
    assert slow.fast is None
    assert [np.frombuffer(b, "<u4").tolist() for b in slow.of(["Don't stop", None])] == [library.encode("Don't stop", add_special_tokens=False).ids, []]


def test_every_character_of_the_basic_plane():
    texts = [f"a{c}b {c} 1{c}2{c}{c}! {c}" for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff"]
    want = LIBRARY.encode_batch_fast(texts, add_special_tokens=False)
    assert OWN.of(texts) == [np.array(e.ids, "<u4").tobytes() for e in want]


def test_long_runs():
    for text in ("a" * 200_000, "!" * 100_000, " " * 50_000 + "x", "\n" * 50_000, "7" * 50_000, "aA" * 50_000):
        assert np.frombuffer(OWN.of([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_white_space_of_every_character():
    for c in map(chr, [*range(0x20), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]):
        for text in (f"a{c}b", f"a {c}b", f"a{c} b", f"a{c}{c}b", f"{c}", f"a{c}"):
            assert np.frombuffer(OWN.of([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids, repr(text)


def apply(sizes, capacity):
    fill = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, many, first, offset in packing.sweep(sizes, capacity):
        for i in range(many):
            fill[first + i].append((offset, length))
            ranks[length].append(rank + i)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in sizes.items()}
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return fill


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sweep_is_best_fit(lengths):
    assert len(apply(dict(Counter(lengths)), 20)) == best_fit(lengths, 20)


def test_sweep_of_millions():
    sizes = {n: 1_000_000 // n for n in range(1, 2049)}
    runs = packing.sweep(sizes, 2048)
    total = sum(n * c for n, c in sizes.items())
    used = max(first + many for _, _, many, first, _ in runs)
    assert used <= 1.001 * total / 2048 + 2 and len(runs) < 100_000


def test_packed_documents(spark):
    rnd = random.Random(4)
    texts = [None, "", " ", "<|endoftext|>", "long " * 5000, "x" * 9000] + [" ".join(rnd.choices("some words of text, é and\nlines".split(" "), k=rnd.randrange(1, 300))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "<|endoftext|>"), (3, "<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, piece string, offset int")
    got = packing.packed(docs, PATH, capacity=256, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        cut, piece = len(ids) % 256 or 256, 0
        for start, end in [(0, cut), *((k, k + 256) for k in range(cut, len(ids), 256))]:
            want.append((i, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes()), tuple(ids[start:end])))
            piece += 1
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got), key=str) == sorted(want, key=str)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(fill) == best_fit([r.length for r in got], 256)


def test_lanes(spark):
    rnd = random.Random(9)
    rows = [(i, 0, rnd.choice([7, 7, 7, rnd.randrange(1, 65)])) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 64, lane_rows=200).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((i, n) for i, _, n in rows)
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(fill) <= best_fit([n for _, _, n in rows], 64) + 5


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
