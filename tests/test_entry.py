"""The registered queries load with and without the training-data operators."""
import importlib.util

import __spark_entry__ as entry
from epitide import catalog


def test_queries_without_training_data_operators(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *rest: None if name.startswith("epitide.llm") else found(name, *rest))
    queries, statements = catalog.load()
    assert set(entry.queries()) == set(queries) and set(entry.oracle_sql()) == set(statements)


def test_queries_without_pipeline(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *rest: None if name == "corpus_pipeline" else found(name, *rest))
    assert "pipeline" not in entry.queries() and set(catalog.load()[0]) <= set(entry.queries())
