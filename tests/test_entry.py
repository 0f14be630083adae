"""The driver contract: names, optional parts, and the flagship query."""

import ast
import pathlib

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_nothing_outside_the_optional_package_imports_it():
    root = pathlib.Path(entry.__file__).parent
    for path in (root / "quantloom").rglob("*.py"):
        if "llm" in path.relative_to(root / "quantloom").parts[:1]:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("quantloom.llm", "corpus_pipeline")) for n in names), path


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 1
