"""Token files and packing: exact round trips through the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assetflow.llm import packing, shards
from assetflow.llm.queries import op1_token_shards, op9_packing
from assetflow.llm.tokens import TextEncoder
from assetflow.session import shared_dir
from helpers import SF, documents, no_docs, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**32 - 1), st.integers(40_000, 50_000)), max_size=700), st.sampled_from([0.01, 0.5, 0.9, 1.0]), st.integers(0, 700), st.integers(0, 700))
def test_blocks_round_trip(values, percentile, a, b):
    data = shards.encode_blocks(np.array(values, np.uint32), percentile)
    assert shards.decode_blocks(data).tolist() == values
    assert shards.decode_blocks(data, a, max(a, b)).tolist() == values[a : max(a, b)]


def test_blocks_are_packed():
    ids = np.random.default_rng(1).integers(0, 1000, 12_800)
    ids[::100] = 49_000
    assert len(shards.encode_blocks(ids)) < 12_800 * 13 / 8
    with pytest.raises(ValueError, match="not a block stream"):
        shards.decode_blocks(b"x" * 40)


ENCODER = TextEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(), st.sampled_from([*"aAéÉ .'!<|\n\x85\x1c", "e\u0301", "\u0130", "\u0130!", "don't", "<|endoftext|>", "Ünïcode."])), max_size=40))
def test_words_encode_as_the_whole(parts):
    raw = "".join(parts).encode("utf-8", "ignore")
    assert ENCODER.encode([raw], 2)[0].tolist() == ids_of(ENCODER.tokenizer, raw.decode()).tolist()


def test_token_file(spark, tokenizer):
    rows = sorted(documents(spark).select("doc_id", "text").collect())
    want, start = [], 0
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op1_token_shards(spark, SF).collect()) == want


def test_token_file_of_odd_rows(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(shards, "SEGMENT_IDS", 8)
    df = odd_docs(spark)
    path = shared_dir(spark, "t")
    shards.write_token_file(df.repartition(3), path, PATH)
    got = sorted(shards.read_token_file(spark, path).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, ids_of(tokenizer, r.text).tobytes()) for r in df.collect())
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda k: (k is not None, k or 0))
    path = shared_dir(spark, "t")
    shards.write_token_file(no_docs(spark), path, PATH)
    assert shards.read_token_file(spark, path).count() == 0


def check_pieces(pieces, ids):
    """Every id in one piece, sequences without gaps, little padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for doc_id, own in docs.items():
        left = sorted(x.tobytes() for x in ids[doc_id])
        for x in ids[doc_id]:
            assert sum(p.length for p in own) == sum(len(y) for y in ids[doc_id])
        if len(left) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(x[at : at + p.length].tobytes())
                at += p.length
    assert docs.keys() == ids.keys()
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


def test_packing(spark, tokenizer):
    ids = {r.doc_id: [ids_of(tokenizer, r.text)] for r in documents(spark, "/root/testdata/sf0.01").collect()}
    sequences = check_pieces(op9_packing(spark, "/root/testdata/sf0.01").collect(), ids)
    assert sequences <= 1.01 * -(-sum(len(x[0]) for x in ids.values()) // 4096)


def test_packing_of_odd_rows(spark, tokenizer):
    from pyspark.sql import functions as F

    df = odd_docs(spark)
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.doc_id].append(ids_of(tokenizer, r.text))
    for windows in (1, 64):
        packed = packing.pack(df.repartition(3), PATH, open_windows=windows).withColumn("ids_crc32", F.crc32("ids"))
        check_pieces(packed.collect(), ids)
    assert packing.pack(no_docs(spark), PATH).count() == 0


def test_open_windows_place_best_fit():
    held = packing.OpenWindows(2, 10)
    assert held.place((0, 0, 6)) is None and held.place((1, 0, 5)) is None
    assert held.place((2, 0, 4)) == [(0, 0, 6), (2, 0, 4)]  # fills the tighter one
    assert held.place((3, 0, 6)) is None
    assert held.place((4, 0, 9)) == [(3, 0, 6)]  # fits none: the fullest goes
