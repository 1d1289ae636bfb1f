"""The package stands without its training-data part."""

from __future__ import annotations

from pathlib import Path

import __spark_entry__ as entry
from quire import registry

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_outside_imports_the_training_data_part():
    inside = {p for p in (ROOT / "quire").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts}
    assert inside and not [p for p in inside if "quire.llm" in p.read_text()]


def test_queries_and_their_sql():
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
