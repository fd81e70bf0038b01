"""The driver contract, with and without the optional subpackage."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tidemark.plans import registry


def test_queries_and_sql_belong_together():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(registry.QUERIES) <= set(contract.queries())


def test_the_library_does_not_import_the_subpackage():
    root = Path(contract.__file__).parent / "tidemark"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "tidemark.llm" not in f.read_text()


def test_only_missing_modules_are_passed_over(monkeypatch):
    def failing(name):
        def load(_):
            raise ImportError("no", name=name)

        return load

    for name in ("tidemark.llm", "xxhash", None):
        monkeypatch.setattr(contract, "import_module", failing(name))
        assert contract.optional("tidemark.llm.queries") is None
    monkeypatch.setattr(contract, "import_module", failing("tidemark.llm.common"))
    with pytest.raises(ImportError):
        contract.optional("tidemark.llm.queries")


@pytest.mark.skipif(not Path(contract.SMOKE_DIR).exists(), reason="no test tables")
def test_entry(spark):
    assert contract.entry(spark).count() == 20
