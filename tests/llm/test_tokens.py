import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitemill.llm import dac, packing, sentencepieces
from sitemill.llm.wordtokens import word_tokenizer

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(alphabet=st.sampled_from("  \n\t\vabTHE▁éÉßΩςİ中😀'<|>0²½_-.,!ths​́") | st.characters(exclude_categories=("Cs",)), max_size=80)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_equal_the_library(text):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = sentencepieces.piece_model(PIECES)
    ids = lib.encode(text)
    assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == ids
    assert model.decode([1, *ids, 2]) == lib.decode([1, *ids, 2])


def test_any_ids_decode_like_the_library(lib):
    rng, model = random.Random(2), sentencepieces.piece_model(PIECES)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31_999), 29_871]) for _ in range(10)]
        assert model.decode(ids) == lib.decode(ids)


def test_unsafe_merges_take_the_leftmost_first(lib):
    model = sentencepieces.piece_model(PIECES)
    assert model.unsafe.any()
    for text in (" " * 37, "a" * 501, "ab" * 300, "=" * 75, "\n" * 9, "0" * 33):
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == lib.encode(text)


def long_words():
    rng = random.Random(9)
    yield "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    yield "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=200_000))
    yield from ("a" * 100_000, "=" * 100_001, "the" * 40_000, "😀é中" * 3000, "ab" * 2049)


def test_long_words_take_seconds_and_equal_the_library(lib):
    model = sentencepieces.piece_model(PIECES)
    for word in long_words():
        began = time.perf_counter()
        ids = np.frombuffer(model.encode([f"so {word} ends"])[0], "<u4").tolist()
        took = time.perf_counter() - began
        assert ids == lib.encode(f"so {word} ends")
        assert took < 30, (len(word), took)
    print(f"{len(word)} characters: {took:.1f} s")


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_the_queue_equals_the_rounds(text):
    model = sentencepieces.piece_model(PIECES)
    words = model.words(text)
    rounds = model.encode_words(words)
    before = sentencepieces.LONG_WORD
    try:
        sentencepieces.LONG_WORD = 3
        assert model.encode_words(words) == rounds
    finally:
        sentencepieces.LONG_WORD = before


def test_codec_of_odd_documents(odd, none, lib):
    got = sentencepieces.encode_decode(odd, PIECES, digest=True).collect()
    want = Counter()
    for r in odd.collect():
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert sentencepieces.encode_decode(none, PIECES).count() == 0
    assert {"ids", "decoded"} <= set(sentencepieces.encode_decode(none, PIECES).columns)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_tokens_equal_the_library(text):
    tokenizer = word_tokenizer(WORDS)
    assert tokenizer.by_word and tokenizer.split
    want = tokenizer.lib.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenizer.encode([text.encode()])[0], "<u4").tolist() == want


def ids_of(text, end):
    return np.array([*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_written_tokens_read_back(odd, none):
    rows = odd.collect()
    got = dac.read_segments(dac.write_segments(odd, WORDS, segment_ids=700)).collect()
    want = Counter()
    for r in rows:
        ids = ids_of(r["text"], 2)
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    assert dac.read_segments(dac.write_segments(none, WORDS)).count() == 0


def test_any_token_is_read_alone(odd, none, spark):
    segments = dac.write_segments(odd, WORDS, segment_ids=700)
    ids = {}
    for r in dac.read_segments(segments).collect():
        ids[r["start"]] = r["n_tokens"]
    assert sorted(ids) == np.cumsum([0, *[ids[s] for s in sorted(ids)]])[:-1].tolist()
    whole = np.concatenate([dac.Segment(bytes(r["content"])).ids() for r in segments.orderBy("part", "segment").collect()])
    asked = [*range(0, len(whole), 97), 0, len(whole) - 1, len(whole), -1]
    positions = spark.createDataFrame([(p,) for p in asked], "position long")
    for grid in (1 << 20, 500):
        got = {r["position"]: r["token"] for r in dac.tokens_at(segments, positions, grid).collect()}
        assert got == {p: int(whole[p]) for p in asked if 0 <= p < len(whole)}
    assert dac.tokens_at(dac.write_segments(none, WORDS), positions).count() == 0


def test_rows_of_one_id_are_dealt_to_several_parts(spark):
    same = spark.createDataFrame([(None if i % 2 else 7, f"text number {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    segments = dac.write_segments(same, WORDS)
    assert segments.select("part").distinct().count() > 2
    assert dac.read_segments(segments).count() == 400


def test_random_access_and_damage():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 49_408, 3000), [0, 255, 256, 65_535, 65_536, 2**32 - 1], np.zeros(600, int)]).astype(np.uint32)
    lengths = [0, 1000, 2606, 0]
    raw = dac.pack(ids, lengths)
    segment = dac.Segment(raw)
    assert [segment.get(i) for i in range(len(ids))] == ids.tolist() == segment.ids().tolist()
    assert [len(d) for d in segment.documents()] == lengths
    with pytest.raises(IndexError):
        segment.get(len(ids))
    with pytest.raises(ValueError):
        dac.Segment(raw[:50] + bytes([raw[50] ^ 1]) + raw[51:]).verify()


def test_differencing_against_its_definition():
    """The same method over full k-tuples, written out."""
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 12))]
        k = rng.randint(1, 6)
        window = packing.differencing(sizes, k)
        assert len(window) == len(sizes) and set(window) <= set(range(k))
        parts = [(-(s if k > 1 else 0), i, [(0, ())] * (k - 1) + [(s, (i,))]) for i, s in enumerate(sizes)]
        n = len(parts)
        while len(parts) > 1:
            parts.sort()
            a, b = parts.pop(0), parts.pop(0)
            both = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a[2], b[2][::-1], strict=True)), key=lambda x: x[0])
            parts.append((-(both[-1][0] - both[0][0]), n, both))
            n += 1
        sums = sorted(s for s, _ in parts[0][2])
        assert sorted(np.bincount(window, weights=sizes, minlength=k).astype(int).tolist()) == sums


def test_windows_hold_their_capacity():
    assert packing.windows([], 10) == []
    assert len(set(packing.windows([10, 10, 10], 10))) == 3
    out = packing.windows([6, 6, 6, 4, 4, 4], 10)
    assert np.bincount(out, weights=[6, 6, 6, 4, 4, 4]).max() <= 10 and max(out) == 2
    with pytest.raises(ValueError):
        packing.windows([11], 10)


def test_packed_documents(odd, none):
    got = packing.pack(odd, WORDS, capacity=256, piece=64, group_pieces=40).collect()
    want = Counter()
    for r in odd.collect():
        ids = ids_of(r["text"], 1)
        for start, length in packing.cuts(len(ids), 256, 64):
            want[r["doc_id"], start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r["length"] for r in got) > 0.9 * 256 * len(windows)
    assert packing.pack(none, WORDS).count() == 0
