"""The entry module without what may be deleted."""

import sys

import pytest

from tracelake.plans import oracle, queries


@pytest.mark.parametrize("lost", ["tracelake.llm", "tracelake.llm.queries", "xxhash"])
def test_queries_without_the_llm_folder_or_what_it_needs(monkeypatch, lost):
    import __spark_entry__

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("tracelake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, lost, None)
    assert set(__spark_entry__.queries()) == set(queries.QUERIES) and set(__spark_entry__.oracle_sql()) == set(oracle.SQL) <= set(queries.QUERIES)
