"""The entry points without the training-data subpackage's dependencies."""

import builtins
import sys

import pytest

import __spark_entry__


@pytest.mark.parametrize("missing", ["zstandard", "tidemark.llm", "corpus_pipeline"])
def test_the_rest_is_there_without(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith(("tidemark.llm", "corpus_pipeline", "zstandard"))]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def refuse(name, *args, **kw):
        if name == missing or name.startswith(missing + "."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", refuse)
    monkeypatch.setitem(sys.modules, missing, None)
    with pytest.warns(UserWarning, match="left out"):
        known = __spark_entry__.queries()
    assert "user_daily_metrics" in known and "pipeline" not in known
    with pytest.warns(UserWarning, match="left out"):
        assert "user_daily_metrics" in __spark_entry__.oracle_sql()
