"""Ranked search against SQL on whole tables and against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assetflow.llm import ranked
from assetflow.llm.queries import op13_ranked_search
from compare import compare, connect
from helpers import ODD_TEXTS, SF, no_docs, odd_docs

ITEMS = "item_id long, text string, rank int, score string"


def plain_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def plain(docs, items, top=20):
    """docs, items: (id, text) -> rows of (item_id, rank, doc_id, score)."""
    held = [(k, Counter(t), len(t)) for k, t in ((k, plain_terms(t)) for k, t in docs) if t]
    n_docs, all_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in {x for x in items if x[1] is not None}:
        scores = []
        for doc_id, tf, n in held:
            m = 100 - 25 + (25 * n * n_docs) // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in plain_terms(text) if t in tf)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else doc_id, -s) for rank, (s, null, doc_id) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **kw):
    table = spark.createDataFrame([(k, t, 7, "x") for k, t in items], ITEMS)
    return sorted(map(tuple, ranked.search(docs, table, **kw).collect()), key=str)


def test_whole_table_matches_sql(spark):
    ok, note, _ = compare(spark, connect(SF), SF, "op13", op13_ranked_search, ranked.SQL)
    assert ok, note


def test_odd_rows(spark):
    items = [(1, "one two"), (1, "one two"), (1, "A b!"), (2, None), (3, ""), (4, "nothing-known"), (None, "c c x\x85q σσς"), (5, "word7 word8 one <|endoftext|>")]
    docs = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(5, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "one")]
    assert found(spark, odd_docs(spark), items) == plain(docs, items)
    assert found(spark, no_docs(spark), items) == []
    assert found(spark, odd_docs(spark), []) == []
    nothing = odd_docs(spark).where("text IS NULL OR text = ''")
    assert found(spark, nothing, items) == []


def test_many_blocks_levels_and_groups(spark, monkeypatch):
    """Terms that occur up to thousands of times, ties, many small blocks, and several groups of items."""
    monkeypatch.setattr(ranked, "GROUP_BYTES", 40)
    monkeypatch.setattr(ranked, "CELLS", 64)
    rng = random.Random(13)
    vocabulary = [f"t{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 40, 400, 3000])))) for k in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(30)] + [(2000, "t1 " * 5000 + "t59")]
    items = [(k, " ".join(rng.choices(vocabulary, k=12))) for k in range(8)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(spark, table, items, top=5) == plain(docs, items, 5)


def test_bounds_hold():
    """No bound is below the exact score, and few documents that cannot be among the best are left."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 3) for k in range(3000)], k=rng.randint(1, 500))).encode() for _ in range(500)]
    asked = ranked.Asked([(k, " ".join(rng.choices(vocabulary, k=20)).encode()) for k in range(5)])
    source = ranked.pa.RecordBatch.from_arrays([ranked.pa.array(range(500)), ranked.pa.array(texts, ranked.pa.binary())], names=["doc_id", "text"])
    made = list(ranked._scan(asked.terms, True)(iter([source])))
    counts = made[-1].to_pylist()[0]
    asked.weigh(counts["n_docs"], counts["all_terms"], dict(zip(counts["term"], counts["df"], strict=True)))
    df = Counter(t for x in texts for t in set(ranked.terms_of(x)))
    assert {asked.terms[k]: n for k, n in zip(counts["term"], counts["df"], strict=True)} == {t: df[t] for t in asked.terms if df[t]}
    excess, seen = [], 0
    for doc_ids, _, item, bound in ranked.bounds(asked, iter(made[:-1])):
        for doc_id, most in zip(doc_ids.tolist(), bound.tolist(), strict=True):
            words = ranked.terms_of(texts[doc_id])
            exact = asked.score(item, Counter(words), len(words))
            assert exact <= most
            excess.append(most > exact)
            seen += 1
    assert seen == 2500 and np.mean(excess) < 0.2


@pytest.mark.parametrize("text", [b"", b"Ab1-c\x00d \xc3\x89\xe3\x81\x82{z}\x7f", b"a_b`c^d[e]"])
def test_terms(text):
    assert ranked.terms_of(text) == [t.encode() for t in plain_terms(text.decode())]
