import ast
from pathlib import Path

import __spark_entry__ as entry
from helixframe.queries import catalogue

ROOT = Path(entry.__file__).parent


def test_nothing_outside_the_subpackage_imports_it():
    for p in [*(ROOT / "helixframe").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(f"{node.module}.{a.name}" for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("helixframe.llm") for n in names), p


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES


def test_no_local_checkpoint_and_no_cross_join():
    for p in (ROOT / "helixframe").rglob("*.py"):
        text = p.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, p
