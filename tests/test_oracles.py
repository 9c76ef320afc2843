"""Every registered query against its SQL, on whole tables."""

import re
import sys

import pytest

import __spark_entry__ as entry
from assetflow.plans.registry import REGISTRY
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    ok, note, _ = compare(spark, con, SF, name, *REGISTRY[name])
    assert ok, note


def test_contract(spark):
    names = entry.queries().keys()
    assert names >= REGISTRY.keys()
    assert all(re.match(r"op\d+_|pipeline$", name) for name in names - REGISTRY.keys())
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() == 1


def test_queries_without_the_language_model_folders(monkeypatch):
    monkeypatch.setitem(sys.modules, "xxhash", None)
    for name in [m for m in sys.modules if m.startswith("assetflow.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    assert entry.queries().keys() == REGISTRY.keys()
