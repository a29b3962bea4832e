"""The entry module adds what can be imported, and hides no error in it."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry


def test_a_missing_package_is_left_out():
    assert entry._optional("no_such_package.queries") is None
    assert entry._optional("tributary.no_such_part.queries") is None


def test_an_error_within_a_module_is_raised(tmp_path, monkeypatch):
    (tmp_path / "broken_part").mkdir()
    (tmp_path / "broken_part" / "__init__.py").write_text("")
    (tmp_path / "broken_part" / "queries.py").write_text("import no_such_package\n")
    (tmp_path / "broken_part" / "other.py").write_text("from tributary.plans import no_such_name\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_part.queries")
    with pytest.raises(ImportError):
        entry._optional("broken_part.other")


def test_queries_have_no_duplicates_and_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
