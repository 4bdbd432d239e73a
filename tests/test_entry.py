"""The driver's contract, and that the library doesn't lean on what can be removed."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_nothing_imports_the_removable_part():
    for file in (ROOT / "timeloom").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", file.read_text(), re.M), file


def test_entry(spark):
    assert entry.entry(spark).columns == ["host", "failed", "last_us"]
