"""Near-duplicates against all pairs, components against relabelling."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assetflow.llm import near_dups
from assetflow.llm.components import components
from helpers import classes_of, documents, no_docs, odd_docs, words


def sets_of(docs, size):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        own = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        out.setdefault(doc_id, []).append(own)
    return out


def brute(docs, size, percent=80):
    sets = [(d, s) for d, own in sets_of(docs, size).items() for s in own]
    links = [
        (a, b)
        for (a, x), (b, y) in itertools.combinations([p for p in sets if p[1]], 2)
        if a != b and 100 * len(x & y) >= percent * len(x | y)
    ]
    return classes_of(links, {d for d, _ in sets})


def check(spark, docs, size):
    got = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=size).collect()
    want, sets = brute(docs, size), sets_of(docs, size)
    assert len(got) == len(docs)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


@pytest.mark.parametrize("size", [4, 5])
def test_documents(spark, size):
    docs = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").collect()]
    check(spark, docs, size)


def test_copies_of_copies_and_common_passages(spark, monkeypatch):
    """Chains that only link step by step, a large group of near copies, and a passage that all share."""
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, common = [], fresh(60)
    chain = fresh(120)
    for _ in range(12):
        chain = chain[:]
        at = rng.randrange(100)
        chain[at : at + 3] = fresh(3)
        texts.append(chain)
    base = fresh(150)
    for _ in range(60):
        copy = base[:]
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(150)] = "changed" + str(rng.random())
        texts.append(copy)
    texts += [fresh(20) + common + fresh(30) for _ in range(60)]
    texts += [texts[20]] * 15
    rng.shuffle(texts)
    check(spark, [(k * 3 + 1, " ".join(t)) for k, t in enumerate(texts)], 4)


A, B = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")


def kept_rows(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_key", F.lit("x"))
    got = near_dups.one_of_each_group(df, **kw)
    assert got.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_a_doc_id_with_several_texts(spark):
    docs = [(9, A), (10, A), (10, B), (12, B)]
    got = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(9, 9, True), (10, 9, False), (10, 9, False), (12, 9, False)]
    # the corpus keeps both texts, each once
    assert kept_rows(spark, docs) == [(10, B), (9, A)]
    assert kept_rows(spark, [*docs, (None, A), (None, "c d e f g h"), (None, "c d e f g h"), (3, None), (3, ""), (3, "")]) == sorted(
        [(9, A), (10, B), (None, "c d e f g h"), (3, None), (3, ""), (3, "")], key=str
    )


def test_a_doc_id_that_a_third_of_the_rows_repeat(spark):
    rng = random.Random(8)
    near = lambda text: " ".join(w if rng.random() > 0.01 else "changed" for w in text.split())
    fresh = [" ".join(f"w{rng.randrange(9000)}" for _ in range(80)) for _ in range(150)]
    docs = [(7, t) for t in fresh] + [(7, A)] * 150 + [(100 + k, near(fresh[k])) for k in range(0, 150, 5)] + [(1000 + k, near(A)) for k in range(20)]
    docs += [(2000 + k, " ".join(f"v{rng.randrange(9000)}" for _ in range(80))) for k in range(200)] + [(None, near(fresh[3])), (None, near(B)), (5, B)]
    check(spark, [d for d in docs if d[0] is not None], 4)
    pairs = near_dups._links(spark.createDataFrame(docs, "doc_id long, text string"), *near_dups._signed_classes(spark.createDataFrame(docs, "doc_id long, text string"), 4, 32)[1:], 4, 80, 32, 14)
    assert pairs.count() < len(docs)  # no link for each pair of repeated rows
    want = {}
    texts = [(i, d, t) for i, (d, t) in enumerate(docs)]
    sets = {i: next(iter(sets_of([(0, t)], 5).values()))[0] for i, _, t in texts}
    links = [(i, j) for i, j in itertools.combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = classes_of(links, set(sets))
    for i, d, t in texts:
        want[groups[i]] = min(want.get(groups[i], (True, 0)), (d is None, d or 0))
    got = kept_rows(spark, docs)
    assert len(got) == len(want) and Counter(d for d, _ in got) == Counter(None if null else d for null, d in want.values())


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = near_dups.near_duplicates(df, shingle=4).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(got) == df.count()
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for k in (0, 1, 2) for r in by_id[k])
    assert {r.component_id for r in by_id[5] + by_id[6]} == {5} and [r.kept for r in by_id[6]] == [False]
    assert {r.component_id for r in by_id[9] + by_id[10]} == {9}
    assert sorted((r.component_id is None, r.component_id) for r in by_id[None]) == [(False, 5), (True, None)]
    assert near_dups.near_duplicates(no_docs(spark)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    path = list(range(40))
    rng.shuffle(path)
    links = list(zip(path, path[1:], strict=False)) + [(100 + k, 100) for k in range(1, 30)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes_of(links, {x for p in links for x in p})
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
