"""The language-model score, the classifier, the pipeline and the registered queries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from assetflow.llm import lattice, leaks, near_dups, quality
from assetflow.llm.queries import REGISTRY, op2_subword_lattice, op8_weak_label_quality
from compare import compare, connect
from helpers import SF, documents, no_docs, odd_docs, words

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


# --- lattice


def all_ways(word, pieces, byte_log):
    """The sum over all segmentations, one by one."""
    text = lattice.START + word

    def walk(i):
        if i == len(text):
            return 1.0
        total = math.exp(byte_log * len(text[i].encode())) * walk(i + 1)
        return total + sum(pieces.get(text[i:j], 0.0) * (1 - lattice.BYTE_SHARE) * walk(j) for j in range(i + 1, len(text) + 1))

    return walk(0)


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "ab": 0.15, "b": 0.05, "▁ab": 0.1, "c": 0.1, "bc": 0.1, "é": 0.1}
    model = lattice.Lattice(list(pieces), np.array(list(pieces.values())))
    own = ["abc", "a", "ccc", "aébc", "xyz", "ab", "日本", "b" * 40]
    got = model.log_probability(own)
    for w, x in zip(own[:-1], got, strict=False):
        assert x == pytest.approx(math.log(all_ways(w, pieces, model.log_byte)), rel=1e-9)
    assert np.isfinite(got).all()


def test_expected_counts_are_the_gradient():
    """d log P / d log p of each piece is how often it is expected."""
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.2, "ab": 0.2, "b": 0.2, "▁ab": 0.1}
    names, p = list(pieces), np.array(list(pieces.values()))
    own = ["abab", "aab", "b"]
    expected = lattice.Lattice(names, p).expected(own)
    for k in range(len(names)):
        up, down = p.copy(), p.copy()
        up[k] *= 1 + 1e-6
        down[k] *= 1 - 1e-6
        slope = (lattice.Lattice(names, up).log_probability(own).sum() - lattice.Lattice(names, down).log_probability(own).sum()) / 2e-6
        assert slope == pytest.approx(expected[k], abs=1e-4)


def plain_base(docs):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    counts, ends = Counter(), 0
    for d, t in docs:
        if not held[d]:
            counts.update(words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for d, t in docs:
        own = [counts[w] for w in words(t)] + [ends]
        out.append((d, held[d], len(own), sum(c > 0 for c in own), n, sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in own)))
    return out


@pytest.mark.parametrize("head", [5, lattice.HEAD_WORDS])
def test_base_scores(spark, head):
    docs = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    got = lattice.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), VOCABULARY, rounds=1, head_words=head).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(docs)
    for d, held, n, known, train, base in plain_base(docs):
        r = by_id[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_head_and_joined_words_score_alike(spark):
    docs = documents(spark)
    a, b = ({r.doc_id: r.score for r in lattice.score_documents(docs, VOCABULARY, rounds=1, head_words=h).collect()} for h in (3, 10**6))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_scores_of_odd_rows(spark):
    df = odd_docs(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known) for r in lattice.score_documents(df, VOCABULARY, rounds=1).collect()))
    assert got == sorted((d is None, d or 0, h, n, k) for d, h, n, k, *_ in plain_base(docs))
    assert lattice.score_documents(no_docs(spark), VOCABULARY, rounds=1).count() == 0


# --- classifier


def test_labellers_accuracies_are_found():
    rng = np.random.default_rng(5)
    n, truth = 20_000, None
    truth = rng.random(n) < 0.2
    right = [0.95, 0.8, 0.7, 0.9]
    votes = np.array([np.where(rng.random(n) < r, truth, ~truth) for r in right]).T.astype(int)
    votes[rng.random(votes.shape) < 0.3] = 2
    model = quality.LabelModel.fit(Counter(quality.code(list(v)) for v in votes.tolist()), 4, [[0, 1, 2, 3]])
    assert model.prior[1] == pytest.approx(0.2, abs=0.03)
    assert model.says_one[:, 1] == pytest.approx(right, abs=0.05)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_documents_are_judged_as_labelled(spark):
    """Labels that the scorer was not fitted to."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    shown, held = labels.where("doc_id % 2 = 0"), {r.doc_id: (r.quality, r.toxic) for r in labels.where("doc_id % 2 = 1").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = Counter((held[r.doc_id], r.kept) for r in quality.score(docs, shown, sample_rows=4000).collect() if r.doc_id in held)
    clean, junk, toxic = ({k: found[key, k] for k in (True, False)} for key in ((1, 0), (0, 0), (1, 1)))
    assert clean[True] >= 0.98 * sum(clean.values()) and junk[False] >= 0.95 * sum(junk.values()) and toxic[False] >= 0.9 * sum(toxic.values())


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    """A labelled doc_id that most rows repeat, with one text or with many."""
    docs = spark.createDataFrame([(7, f"text number {k % 40}") for k in range(3000)] + [(k, f"another {k}") for k in range(100, 140)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0)] + [(k, k % 2, 0) for k in range(100, 140)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "learn_lexicon", lambda buckets, toxic, f=quality.learn_lexicon: seen.append(len(buckets)) or f(buckets, toxic))
    quality.fit(docs, labels, sample_rows=60)
    quality.fit(docs, labels, sample_rows=1000)
    assert seen == [60, 80]


def test_odd_judgements(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 1), (9, None, None), (3, 1, 7)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text")
    df = odd_docs(spark)
    for given in (labels, labels.limit(0)):
        got = quality.score(df, given).collect()
        assert len(got) == df.count() and all(not r.kept and r.junk == 1.0 for r in got if r.doc_id in (0, 1, 2))
    assert quality.score(no_docs(spark), labels).count() == 0


# --- pipeline


def by_hand(spark, sf):
    """What the filtering stages keep, from plain computations on what the classifier keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, corpus_pipeline.keep_quality(spark, docs, sf)


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, good = by_hand(spark, sf)
    judged = {r.doc_id for r in op8_weak_label_quality(spark, sf).collect() if r.kept}
    assert {r.doc_id for r in good.collect()} == judged and good.schema == docs.schema
    one = corpus_pipeline.keep_one_of_each_group(spark, good, sf)
    kept = {r.doc_id for r in near_dups.near_duplicates(good, shingle=5).collect() if r.kept}
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    clean = corpus_pipeline.drop_benchmark_copies(spark, one, sf)
    leaked = {r.doc_id for r in leaks.find_leaks(one, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert leaked and {r.doc_id for r in clean.collect()} == kept - leaked
    safe = corpus_pipeline.redact_secrets(spark, clean, sf)
    rows = safe.collect()
    assert len(rows) == len(kept - leaked) and all(r.n_chars == len(r.text) for r in rows) and any("[secret]" in r.text for r in rows)
    assert safe.columns == docs.columns and dict(safe.dtypes) == dict(docs.dtypes)
    pieces = corpus_pipeline.pack_sequences(spark, safe, sf).collect()
    assert {p.doc_id for p in pieces} == kept - leaked


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    lengths = defaultdict(int)
    for p in got:
        lengths[p.sequence_id] += p.length
    assert got and max(lengths.values()) <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_stages_take_odd_rows(spark):
    df = odd_docs(spark)
    docs = df.select("doc_id", "text", "lang", "source", "n_chars", "size")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert Counter(r.doc_id for r in one.collect()) == Counter({0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1, 11: 1, 12: 1, None: 1})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), SF).count() == 0


# --- registration


@pytest.mark.parametrize("name", sorted(n for n, (_, text) in REGISTRY.items() if text))
def test_query_matches_sql(spark, name):
    ok, note, _ = compare(spark, connect(SF), SF, name, *REGISTRY[name])
    assert ok, note


def test_registered():
    found = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert set(entry.oracle_sql()) <= set(found)
