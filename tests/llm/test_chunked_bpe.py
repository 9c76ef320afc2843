"""Chunked encoding against the tokenizers library itself."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assetflow.llm import chunked_bpe
from assetflow.llm.queries import op12_chunked_bpe
from helpers import ODD_TEXTS, SF, documents, no_docs, odd_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
PARTS = ["a", "bc", " ", "  ", "\n", "'", "'s", "'l", "l", "'r", "e", "12", "!", "é", "日本", "́", "😀", "<|endoftext|>", "<|endof", " the", "don't", "word" * 30, " " * 50]


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.fixture
def small_chunks(monkeypatch):
    for name, value in (("LEAST", 8), ("MOST", 40), ("ZERO_BITS", 2), ("REACH", 6), ("REMEMBERED", 2_000)):
        monkeypatch.setattr(chunked_bpe, name, value)


def test_joins_are_repaired(small_chunks):
    encoder = chunked_bpe.ChunkEncoder(PATH)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs"])), max_size=120))
    def check(parts):
        text = "".join(parts)
        assert encoder.encode([text.encode()])[0].tolist() == ids_of(text)

    check()


def test_cuts_follow_the_content():
    passage = " ".join(f"w{k * k % 977}" for k in range(4_000)).encode()
    pieces = []
    for before in (b"", b"x" * 77, b"a much longer opening " * 40):
        data = before + passage
        ends = chunked_bpe.cuts(data)
        assert ends[-1] == len(data) and ends == sorted(set(ends))
        assert max(np.diff([0, *ends])) <= chunked_bpe.MOST
        pieces.append({data[a:b] for a, b in zip([0, *ends], ends, strict=False)})
    assert len(pieces[0] & pieces[1]) > 0.7 * len(pieces[0]) and len(pieces[0] & pieces[2]) > 0.7 * len(pieces[0])


def test_shared_chunks_are_encoded_once():
    encoder = chunked_bpe.ChunkEncoder(PATH)
    passage = " ".join(f"w{k * k % 977}" for k in range(4_000))
    encoder.encode([passage.encode(), ("Something else. " + passage).encode(), passage.encode()])
    assert encoder.encoded < 1.5 * len(passage)


def test_whole_table(spark):
    got = {r.doc_id: r for r in op12_chunked_bpe(spark, SF).collect()}
    rows = documents(spark).collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = ids_of(row.text)
        r = got[row.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    coded = chunked_bpe.decode(chunked_bpe.encode(odd_docs(spark), PATH), PATH)
    got = sorted((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in coded.collect())
    texts = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(5, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "one")]
    assert got == sorted((k is None, k or 0, ids_of(t), t or "") for k, t in texts)
    assert chunked_bpe.encode(no_docs(spark), PATH).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff62' AS STRING) AS text")
    assert chunked_bpe.decode(chunked_bpe.encode(broken, PATH), PATH).first().decoded == "a�b"


def test_a_task_has_one_worker_with_a_tokenizer(spark):
    """Ids are decoded beside their encoder: the same rows as from both steps, with no second Python worker in the stage."""
    both = chunked_bpe.encode_and_decode(odd_docs(spark), PATH)
    two_steps = chunked_bpe.decode(chunked_bpe.encode(odd_docs(spark), PATH), PATH)
    assert sorted(map(repr, both.collect())) == sorted(map(repr, two_steps.collect()))
    plan = op12_chunked_bpe(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
