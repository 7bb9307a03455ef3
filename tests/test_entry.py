"""The driver's entry with and without the training-data part."""

import sys

import pytest

import __spark_entry__ as contract
from segmill.plans import oracle, queries as registered


@pytest.mark.parametrize(
    "hidden",
    [["segmill.llm", "segmill.llm.registered"], ["segmill.llm", "segmill.llm.registered", "corpus_pipeline"]],
)
@pytest.mark.filterwarnings("ignore:training-data queries left out")
def test_other_queries_without_the_training_part(monkeypatch, hidden):
    for name in [n for n in sys.modules if n.startswith("segmill.llm.") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in hidden:
        monkeypatch.setitem(sys.modules, name, None)
    assert set(contract.queries()) == set(registered.queries())
    assert set(contract.oracle_sql()) == set(oracle.oracle_sql())


@pytest.mark.filterwarnings("ignore:training-data queries left out")
def test_operators_without_the_pipeline(monkeypatch):
    pytest.importorskip("segmill.llm.registered")
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found = set(contract.queries()) - set(registered.queries())
    assert found and all(name.startswith("op") for name in found)
