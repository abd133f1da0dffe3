"""Every registered query of the library against its SQL."""

import subprocess
import sys

import pytest
from conftest import DATA, ROOT
from oracle import connect, same

from storeops.plans import catalog

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_each_query_has_sql():
    assert len(catalog.QUERIES) == 82
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["tiktoken", "storeops.llm", "corpus_pipeline"])
def test_entry_module_without_what_only_some_queries_need(name):
    """In a process of its own, where the module can't be imported."""
    code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; assert set(e.queries()) == set(e.catalog.QUERIES)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert not done.returncode and "left out" in done.stderr, done.stderr


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["store_id", "labor_cost"]
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
