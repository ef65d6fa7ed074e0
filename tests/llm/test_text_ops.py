"""Substring removal, packing and token files."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.common import Pieces, encode_texts
from tessera.llm.packing import BYTE_PIECES, BestFit, pack, pieces
from tessera.llm.substrings import remove_repeats
from tessera.llm.token_files import _Model, _shares, WORD_PIECES, decode_blocks, encode_blocks, pack_segment, read_segment, read_tokens, write_tokens


def kept_words(rows, span):
    """What remove_repeats should leave, by looking at every window."""
    owner = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            owner[key] = min(owner.get(key, d), d)
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - span + 1) if owner[tuple(w[i : i + span])] < d for j in range(i, i + span)}
        left = [x for j, x in enumerate(w) if j not in gone]
        out.append((d, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out)


def test_repeats_of_odd_documents(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    got = remove_repeats(odd).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == kept_words(rows, 50)
    assert any(x[2] for x in kept_words(rows, 50))
    assert remove_repeats(odd.limit(0)).collect() == []


def test_repeats_at_every_bound(spark):
    r = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for d in range(60):
        a, b = sorted(r.integers(0, 71, 2))
        rows.append((int(d), " ".join([f"d{d}_{i}" for i in range(r.integers(0, 30))] + passage[a:b] + [f"e{d}_{i}" for i in range(r.integers(0, 30))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (64, 7):  # of 7 bits, most hashes of windows collide
        got = remove_repeats(df, bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert sorted(tuple(x) for x in got.collect()) == kept_words(rows, 50), bits


AWKWARD = ["<|endoftext|> a  b c\n\n d's 'Sİ é ́x", "", None, "  lead", "x  ", " a   b　c", "a\x0b\x0cb\x1cc \x85d", "'s's ' s 12,345.67", "\U0001f600\U0001f468‍\U0001f469 é"]


@pytest.mark.parametrize("name, pattern", [("word_bpe_49k.json", WORD_PIECES), ("byte_bpe_50k.json", BYTE_PIECES)])
def test_ids_are_the_tokenizers(name, pattern):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in AWKWARD]
    assert [x.tolist() for x in encode_texts(path, AWKWARD, pattern, name.startswith("word"))] == want


LOADED = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" ,-abBcC\t\n  \x1c\x85aB1'.s<|>́İé"), max_size=40))
def test_ids_of_any_text(text):
    for name, pattern in (("word_bpe_49k.json", WORD_PIECES), ("byte_bpe_50k.json", BYTE_PIECES)):
        assert encode_texts(public_tokenizers.path(name), [text], pattern, name.startswith("word"))[0].tolist() == LOADED[name].encode(text, add_special_tokens=False).ids


def test_pieces():
    assert list(pieces(5, 4)) == [(0, 1), (1, 4)] and list(pieces(4, 4)) == [(0, 4)] and list(pieces(3, 4)) == [(0, 3)] and list(pieces(9, 4)) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_takes_the_fullest_bin_that_fits():
    bins = BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    bins = BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]  # bin 1 was the fullest and closed


def test_packing(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = pack(odd, path).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((-1 if d is None else d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, x in texts)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[-1 if r.doc_id is None else r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    got = []
    for d, own in docs.items():
        own.sort(key=lambda r: r.piece)
        copies = sum(r.piece == 0 for r in own)
        joined = b"".join(bytes(r.ids) for r in own)
        got += [(d, joined[i * len(joined) // copies : (i + 1) * len(joined) // copies]) for i in range(copies)]
    assert sorted(got) == want
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += len(r.ids) // 4
        assert at <= 1024
    assert pack(odd.limit(0), path).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.sampled_from([1, 3, 8, 17, 18]), st.data())
def test_coder_round_trip(bits, data):
    blocks = data.draw(st.lists(st.lists(st.integers(0, 2**bits - 1), min_size=1, max_size=80), min_size=1, max_size=5))
    arrays = [np.array(b, np.uint32) for b in blocks]
    back = decode_blocks(encode_blocks(arrays, bits), [len(b) for b in blocks], bits)
    assert [x.tolist() for x in back] == blocks


def test_coder_predicts():
    ids = np.tile(np.arange(40_000, 40_050, dtype=np.uint32), 40)
    assert len(encode_blocks([ids], 16)[0]) < len(ids) / 2  # orders 1 and 2
    few = np.random.default_rng(3).choice(np.arange(30_000, 60_000, 1_000, dtype=np.uint32), 4_000)
    size = len(encode_blocks([few], 16)[0]) * 8 / len(few)
    assert size < 7  # order 0 alone: 30 ids at random, of which each takes log2(30) = 4.9 bits, after it has learned them


def test_order_0_shares_add_up():
    """The frequencies of all ids fill the total, before and after it learned some; find() is the inverse."""
    model, lane = _Model(1, 6), np.zeros(64, np.int64)
    r = np.random.default_rng(4)
    for x in [None, *r.integers(0, 64, 50)]:
        if x is not None:
            model.share(np.array([0]), np.array([x]))
        kept = model.left.copy(), model.seen.copy()
        parts = []
        for i in range(64):
            parts.append([int(v[0]) for v in model.share(np.array([0]), np.array([i]))])
            model.left, model.seen = kept[0].copy(), kept[1].copy()
        at = 0
        for below, own, total in parts:
            assert below == at and own > 0
            at += own
        assert at == parts[0][2]
        found = [int(model.find(lane[:1], np.array([v], np.uint64))[0][0]) for b, o, _ in parts for v in (b, b + o - 1)]
        assert found == [i for i in range(64) for _ in (0, 1)]


def test_order_0_takes_a_row_for_four_bits():
    """What an id touches are its path's rows of 16 counts, from encoder and decoder alike."""
    model, lanes, x = _Model(3, 16), np.arange(3), np.array([5, 40_000, 65_535])
    assert model.left.shape == (3 * (1 + 16 + 256 + 4096), 16)
    below, own, _ = (a.copy() for a in model.share(lanes, x))
    assert (model.left.any(axis=1).sum(), model.left.max()) == (12, 1)
    found, at, rows = model.find(lanes, below)  # the first value of each id; now seen once, so its share is larger
    assert found.tolist() == x.tolist() and at.shape == (3, 4) and rows.shape == (3, 4, 16)
    again = model.share(lanes, x, at, rows)
    assert again[0].tolist() == below.tolist() and (again[1] > own).all() and model.left.max() == 2


@pytest.mark.parametrize("bits,lanes,steps", [(6, 3, 90), (16, 33, 40), (18, 2, 17), (1, 1, 1)])
def test_order_0_of_whole_blocks(bits, lanes, steps):
    """The encoder's shares, counted over whole blocks, are those that the decoder's model gives step by step."""
    r = np.random.default_rng(bits)
    ids, other = r.integers(0, 1 << bits, (steps, lanes)).astype(np.uint32), r.random((steps, lanes)) < 0.8
    ids[::3] = ids[0]
    other[:, 0] = lanes == 1
    shares, model = _shares(_Model(lanes, bits).tree, ids, other), _Model(lanes, bits)
    for t in range(steps):
        at = np.flatnonzero(other[t])
        want = np.repeat(np.array([[0], [1], [1]], np.uint64), lanes, axis=1)
        if len(at):
            want[:, at] = model.share(at, ids[t, at].astype(np.int64))
        assert shares[:, t].tolist() == want.tolist()


def test_blocks_of_any_length():
    r = np.random.default_rng(8)
    blocks = [np.minimum(r.zipf(1.2, n), 40_000).astype(np.uint32) for n in (300, 300, 1, 0, 17)]
    payloads = encode_blocks(blocks, 16)
    assert [x.tolist() for x in decode_blocks(payloads, [len(b) for b in blocks], 16)] == [b.tolist() for b in blocks]
    with pytest.raises(ValueError):
        pack_segment([1], [np.zeros(1 << 16, np.uint32)], 1 << 16)


def test_latin_words_take_the_bpe_model():
    """Words of Latin letters get the whole tokenizer's ids without running it, but for a letter with two lower-case ones."""
    path = public_tokenizers.path("word_bpe_49k.json")
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    words = [*letters, *(f"{a}{c}{b}," for c in letters for a, b in (("q", "Z"), ("\u00c9", "\u0178")))]
    want = [LOADED["word_bpe_49k.json"].encode(w, add_special_tokens=False).ids for w in words]
    cache, whole = Pieces(path, True), []
    real, cache.whole = cache.whole, type("Whole", (), {"encode": lambda _, p, **k: whole.append(p) or real.encode(p, **k)})()
    assert [np.frombuffer(cache[w], np.uint32).tolist() for w in words] == want
    assert {p for p in whole if p != ","} == {w for w in words if "\u0130" in w}


def test_large_ids():
    docs, ids = read_segment(pack_segment([1], [np.array([2**24 - 1, 5, 2**24 - 1], np.uint32)], 8))
    assert ids[0].tolist() == [2**24 - 1, 5, 2**24 - 1]
    with pytest.raises(ValueError):
        pack_segment([1], [np.array([2**24], np.uint32)], 8)


def test_segment_finds_damage():
    data = bytearray(pack_segment([3, None, 5], [np.arange(5, dtype=np.uint32), np.array([1], np.uint32), np.arange(900, dtype=np.uint32)], 64))
    docs, ids = read_segment(bytes(data))
    assert docs == [3, None, 5] and [len(x) for x in ids] == [5, 1, 900]
    for at in (0, 10, 31, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            read_segment(bytes(bad))


def test_token_files(spark, odd, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    write_tokens(odd, path, f"file://{tmp_path}/t", block_ids=50, segment_ids=300)
    got = sorted(read_tokens(spark.read.parquet(f"file://{tmp_path}/t")).collect(), key=lambda r: r.start)
    want = [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in odd.collect()]
    assert [r.doc_id for r in got] == sorted((d for d, _ in want), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    crc = lambda d, raw: (-1 if d is None else d, zlib.crc32(raw))
    assert sorted(crc(r.doc_id, bytes(r.ids)) for r in got) == sorted(crc(d, np.array(x, "<u4").tobytes()) for d, x in want)
    write_tokens(odd.limit(0), path, f"file://{tmp_path}/e")
    assert read_tokens(spark.read.parquet(f"file://{tmp_path}/e")).collect() == []
