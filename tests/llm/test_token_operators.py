"""BPE, packing and the id store against the public libraries."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import make_docs, odd_texts
from tests.conftest import data_dir
from trajloom.llm import bpe, idcoder, idstore, packing


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe.default_ranks())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=bpe.default_ranks()[1], mergeable_ranks=codec.merges.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab 'st\n\té1²<|>", max_size=80))
def test_encode_equals_library(text):
    c = bpe.codec(*bpe.default_ranks())
    enc = tiktoken.Encoding("own", pat_str=bpe.default_ranks()[1], mergeable_ranks=c.merges.ranks, special_tokens={})
    ids = [i for part in c.encode(text) for i in part]
    assert ids == enc.encode_ordinary(text)
    d = bpe.Decoder(c.merges.bytes_of)
    assert "".join(d.feed([i]) for i in ids) + d.close() == text


def test_fits_is_bpe_of_the_joined_bytes(codec):
    import random

    r, m = random.Random(2), codec.merges
    tokens = [i for i in range(len(m.bytes_of)) if 0 < len(m.bytes_of[i]) < 9]
    for _ in range(4000):
        a, b = r.choice(tokens), r.choice(tokens)
        if m.merge(m.bytes_of[a]) == [m.bytes_of[a]] and m.merge(m.bytes_of[b]) == [m.bytes_of[b]]:
            assert m.fits(a, b) == (m.merge(m.bytes_of[a] + m.bytes_of[b]) == [m.bytes_of[a], m.bytes_of[b]])


def test_long_words_settle_with_bounded_lookahead(codec, library):
    for word in ("a" * 3000, "ab" * 1500, "thequickbrown" * 200, "é" * 800):
        assert codec.transducer.encode(word.encode()) == library.encode_ordinary(word)
    assert max(map(len, codec.transducer.pending)) < 300


def test_round_trip(spark, odd, empty, library):
    want = []
    for i, t in odd_texts():
        ids = library.encode_ordinary(t or "")
        want.append((repr(i), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((repr(r[0]), *r[1:]) for r in bpe.round_trip(odd).collect()) == sorted(want)
    assert bpe.round_trip(empty).count() == 0


def pieces_by_hand(text, size):
    t = packing._tokenizer(packing.default_ids().path)
    ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
    cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(spark, odd, empty, size):
    got = [tuple(r) for r in packing.pack(odd, size).collect()]
    want = sorted((repr(i), *p) for i, t in odd_texts() for p in pieces_by_hand(t, size))
    assert sorted((repr(r[0]), *r[1:5]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_places_every_piece(counts):
    patterns = packing.plan(counts, 40)
    used = {}
    for times, lengths in patterns:
        assert sum(lengths) <= 40
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts
    least = -(-sum(k * v for k, v in counts.items()) // 40)
    assert sum(t for t, _ in patterns) <= max(least + 3, int(1.5 * least) + 1, sum(v for k, v in counts.items() if k > 20) + least)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 65534) | st.integers(0, 3), max_size=900), st.integers(0, 3))
def test_id_store_round_trip(ids, seed):
    ids = np.array(ids, dtype=np.int64)
    docs = pa.table({"doc_id": pa.array([1], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})
    data = idstore.pack_segment(docs, ids)
    table, back = idstore.read_segment(data)
    assert (back == ids).all() and len(back) == len(ids) and table.equals(docs)


def test_damage_is_found():
    docs = pa.table({"doc_id": [1], "n_tokens": [500]})
    data = bytearray(idstore.pack_segment(docs, np.arange(500)))
    data[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        idstore.read_segment(bytes(data))
    with pytest.raises(ValueError):
        idstore.pack_segment(docs, np.array([70_000]))


def test_repeats_shrink():
    docs = pa.table({"doc_id": [1], "n_tokens": [200_000]})
    r = np.random.default_rng(0)
    plain = len(idstore.pack_segment(docs, r.integers(0, 50_000, 200_000)))
    repeats = len(idstore.pack_segment(docs, np.tile(r.integers(0, 50_000, 50), 4000)))
    assert plain < 2.3 * 200_000 and repeats < plain / 12


def test_ids_are_smaller_than_by_zlib_and_by_their_entropy(spark):
    """On the given documents; and every order of the mixture brings something."""
    texts = [r["text"] or "" for r in spark.read.parquet(f"{data_dir('0.01')}/documents.parquet").orderBy("doc_id").collect()]
    ids = np.concatenate(idstore.word_ids(idstore.default_tokenizer())(texts, 1)).astype(np.int64)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() * len(ids) / 8
    size = lambda *weigh: len(idcoder.encode_block(ids, weigh))
    zero, one, two, all_ = size(0, 0), size(1, 0), size(0, 1), size(1, 1)
    assert all_ < 0.85 * entropy and all_ < 0.8 * len(zlib.compress(ids.astype("<u2").tobytes(), 6))
    assert all_ < one < zero and all_ < two < zero
    assert (idcoder.decode_block(idcoder.encode_block(ids)) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65_535) | st.sampled_from([0, 1, 65_535]), min_size=1, max_size=700))
def test_block_round_trip(ids):
    ids = np.array(ids, np.int64)
    assert (idcoder.decode_block(idcoder.encode_block(ids)) == ids).all()


def test_an_id_takes_few_digits(spark):
    """What a block costs grows with the digits of its ids (2.2 an id in a code of 16 digits)."""
    texts = [r["text"] or "" for r in spark.read.parquet(f"{data_dir('0.001')}/documents.parquet").collect()]
    _, counts = np.unique(np.concatenate(idstore.word_ids(idstore.default_tokenizer())(texts, 1)), return_counts=True)
    assert (idcoder._lengths(counts) * counts).sum() < 1.5 * counts.sum()


@pytest.mark.parametrize("kinds", [1, 2, 300, 40_000])
def test_digits_are_found_in_their_own_shares(kinds):
    """At each point of a lane's range, whatever the model has learned, the digit found is the one whose share it is."""
    r = np.random.default_rng(kinds)
    lengths = idcoder._lengths(r.zipf(1.3, kinds).clip(1, 1000))
    tree = idcoder.Tree(lengths)
    model, lanes = idcoder.Model(tree), 512
    last = before = np.zeros(lanes, np.int64)
    for _ in range(60):
        x = (r.zipf(1.2, lanes) - 1) % kinds
        model.begin(last, before)
        model.look(None, None, 0, None)
        bounds = [model.span(np.full(lanes, d)) for d in range(idcoder.RADIX)]
        for d, (low, share) in enumerate(bounds):
            assert (share > 0).all() and (low == (bounds[d - 1][0] + bounds[d - 1][1] if d else 0)).all()
        assert (low + share <= idcoder.SHARES).all()
        digit = r.integers(0, idcoder.RADIX, lanes)
        low, share = model.span(digit)
        for v in (low, low + share // 2, low + share - 1):
            assert (model.find(v) == digit).all()
        digit = tree.digit[0].take(x)
        model.span(digit)
        model.learn(digit)
        model.end(x)
        before, last = last, x


def test_long_blocks_come_back():
    """Many lanes, codes of three digits and more, carries; two blocks of a segment."""
    r = np.random.default_rng(5)
    ids = np.r_[r.zipf(1.2, 400_000) % 65_536, np.arange(65_536), np.full(100_000, 7)]
    assert (idcoder.decode_block(idcoder.encode_block(ids)) == ids).all()
    ids = np.tile(r.integers(0, 50, 3000), -(-(idcoder.BLOCK + 5000) // 3000))
    docs = pa.table({"doc_id": [1], "n_tokens": [len(ids)]})
    assert (idstore.read_segment(idstore.pack_segment(docs, ids))[1] == ids).all()


def test_words_end_where_the_vocabulary_says():
    """New words go through the library's call without offsets; where tokens don't tell the words, through the one with them."""
    own, plain = idstore.WordIds(idstore.default_tokenizer()), idstore.WordIds(idstore.default_tokenizer())
    assert own.closes is not None
    plain.closes = None
    texts = ["".join(chr(k) for k in range(1, 256)), "</w> a</w>b x</w", "unheardofword's wo'nt \u00e0\u00ad\u00ff caf\u00e9 7\u00b2"]
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [x.tolist() for x in own(texts, 1)] == [x.tolist() for x in plain(texts, 1)] == want
    own._clear()
    own.closes = np.zeros_like(own.closes)
    assert [x.tolist() for x in own(texts, 1)] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("ab 'stmdrevl\n\té1²<|>\0ſK", max_size=40), max_size=5))
def test_words_equal_library(texts):
    own = idstore.word_ids(idstore.default_tokenizer())
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [x.tolist() for x in own(texts, 1)] == want


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(idstore, "MAX_WORDS", 50)
    own = idstore.WordIds(idstore.default_tokenizer())
    for k in range(20):
        texts = [f"word{'x' * j} and{chr(97 + k)} other{'y' * 20}{chr(97 + j)} \u00e9t\u00e9" for j in range(9)]
        assert [x.tolist() for x in own(texts, 1)] == [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_store_and_read(spark, odd, empty):
    t = idstore.word_ids(idstore.default_tokenizer()).tokenizer
    got = idstore.store_and_read(odd).collect()
    start, want = 0, []
    for i, text in sorted(odd_texts(), key=lambda x: (x[0] is not None, x[0] or 0, np.uint64(xxhash.xxh64_intdigest((x[1] or "").encode(), 42)).astype(np.int64))):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((repr(i), start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted((repr(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert idstore.store_and_read(empty).count() == 0
