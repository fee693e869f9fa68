"""Every query of the catalogue against its SQL, or for rows alone where SQL cannot express it."""

import os

import pytest

from lexiflow.plans.queries import CATALOG
from tests.oracle import compare

#: Few plans as wide as these; the others cover their parts.
SLOW = {"people_grid", "normalize_phrase", "suitable_paradigms", "analyze_words", "ranked_vocabulary"}


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_sql(spark, sf001, name):
    if name in SLOW and not os.environ.get("ALL_QUERIES"):
        pytest.skip("set ALL_QUERIES to run it")
    query, sql = CATALOG[name]
    compare(spark, name, query, sql, sf001)


@pytest.mark.parametrize("name", ["exact_tokens", "mija_roundtrip", "viterbi_lattice"])
def test_rows(spark, sf001, name):
    assert CATALOG[name][0](spark, sf001).count() > 0


def test_entry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["suffix_ending_match", "stem_lookup", "mija_analysis", "tokenize_documents"])
def test_plans_have_no_pairwise_joins(spark, sf001, name):
    plan = CATALOG[name][0](spark, sf001)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
