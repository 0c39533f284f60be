"""Byte-level BPE and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefold.llm import byte_bpe, packing
from tracefold.llm.split import parts

PATH, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a" * 5001, "ab" * 3000, "<|endoftext|> x", "abcabcabcab" * 500, "日本" * 999, " " * 777, "\n \n  x", "it's we'll 12³Ⅷ_x\x1c\x85́  end", "x \t\r\n y"]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def test_ids_are_the_librarys(codec, reference):
    random_ = random.Random(2)
    texts = ODD + ["".join(random_.choice("abc  \n\té😀'sz0 .ZqQ日_²Ⅷ\x1c\x85́\xa0") for _ in range(random_.randint(0, 60))) for _ in range(1500)]
    assert [*codec.lists(texts)] == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_text_round_trips(codec, reference, texts):
    found = [*codec.lists(texts)]
    assert found == [reference.encode_ordinary(t) for t in texts]
    assert [codec.decode(i) for i in found] == [t.encode() for t in texts]


def test_small_vocabulary_overlaps():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ba": 258, b"aab": 259}
    replay, reference = byte_bpe.MergeReplay(ranks), tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    words = ["a" * n for n in range(1, 12)] + ["baab", "aaabaaab", "baaaab", "abab"]
    ids, counts = replay.encode([w.encode() for w in words])
    stops = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for n, b in zip(counts, stops, strict=True)] == [reference.encode_ordinary(w) for w in words]


def test_long_texts_are_cut_between_matches():
    text = "word and, more\n\n words  here " * 400
    cut = list(parts(text, 100))
    assert len(cut) > 50 and "".join(cut) == text
    find = __import__("regex").compile(public_tokenizers.PATTERN).findall
    assert [w for p in cut for w in find(p)] == find(text)


def test_encode_and_decode_operators(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (None, "x y")]
    encoded = byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, public_tokenizers.PATTERN)
    assert [bytes(r.decoded) for r in byte_bpe.decode(encoded, PATH).collect()] == [(t or "").encode() for _, t in rows]
    assert byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def library_ids(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def word_lists(texts, **options):
    ids, stops = packing.word_ids(JSON, public_tokenizers.PATTERN, **options).encode(texts)
    return [ids[a:b].tolist() for a, b in zip([0, *stops], stops, strict=False)]


def test_word_ids_are_the_librarys(library):
    random_ = random.Random(6)
    pieces = ["<|endoftext|>", "<|endoftext|>", "<|", "endoftext", "|>", " ", "  ", "\n", " x", "it's", "é", "\u3000", "\x1c", "12", "_", "日本"]
    texts = ODD + ["".join(random_.choice(pieces) for _ in range(random_.randint(0, 25))) for _ in range(3000)]
    assert word_lists(texts) == library_ids(library, texts)
    assert word_lists(["a <|endoftext|>"])[0][-1] == 50256


def test_special_strings_as_text(reference):
    assert word_lists(ODD, as_text=True) == [reference.encode_ordinary(t) for t in ODD]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(max_size=12), st.just("<|endoftext|>")), max_size=6).map("".join), max_size=6))
def test_any_words_are_the_librarys(library, texts):
    assert word_lists(texts) == library_ids(library, texts)


def plain_best_fit(histogram, capacity):
    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                n += 1
                rooms.append(capacity - length)
    return n


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=12))
def test_plan_is_best_fit_decreasing(histogram):
    plan = packing.best_fit_plan(histogram, 64)
    used = {}
    for length, n in histogram.items():
        rows = sorted(r for r in plan.tolist() if r[0] == length)
        for rank in range(n):
            _, first, sequence, each, offset = [r for r in rows if r[1] <= rank][-1]
            k = rank - first
            used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) == plain_best_fit(histogram, 64)


def test_packing_whole_tables(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000), (-4, "a"), (-4, "a"), (None, "b"), (-5, "a <|endoftext|> b<|endoftext|>")], "doc_id long, text string")
    rows = docs.unionByName(extra)
    got = packing.pack(spark, rows, JSON, public_tokenizers.PATTERN).toPandas()
    texts = {r.doc_id: r.text or "" for r in rows.collect() if r.doc_id is not None}
    for doc, own in got[got["doc_id"].notna() & (got["doc_id"] != -4)].groupby("doc_id"):
        ids = [*library_ids(library, [texts[int(doc)]])[0], 0]
        own = own.sort_values("piece")
        assert own["length"].sum() == len(ids) and own["length"].max() <= 2048 and (own["length"].iloc[1:] == 2048).all()
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    ordered = got.sort_values(["sequence_id", "offset"])
    for _, own in ordered.groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
    histogram = got["length"].value_counts().to_dict()
    assert got["sequence_id"].nunique() == plain_best_fit(histogram, 2048)
    assert packing.pack(spark, extra.limit(0), JSON, public_tokenizers.PATTERN).count() == 0
