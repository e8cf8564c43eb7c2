"""Every registered query against its SQL twin, on whole tables."""

import importlib.util
import re

import pytest
from compare import connect, differences
from conftest import ROOT, SMALL

spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry_module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_module)

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
OPTIONAL = {n for n in QUERIES if re.match(r"op\d+_|pipeline$", n)}

# Compared with a tokenizer library in test_bpe.py: SQL cannot follow so many merges.
BY_LIBRARY = {"bpe_learn", "bpe_learn_words", "bpe_encode", "bpe_encode_words", "tokenizer_file"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_only_known_queries_have_no_twin():
    assert set(QUERIES) - set(ORACLES) <= OPTIONAL | BY_LIBRARY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, ORACLES[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
