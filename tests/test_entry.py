"""The entry, and the library without its optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["k", "value", "tt"] and found.count() > 0


def test_every_engine_query_has_sql():
    from tidemark.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_the_rest_imports_without_the_optional_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'pipeline' not in q and not [n for n in q if n.startswith('op')]; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)}, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 140
    tested = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_stretches.py", "tests/test_catalogue.py", "-k", "stretches or row_counts or top_k"], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)}, timeout=300)
    assert tested.returncode == 0 and " passed" in tested.stdout, tested.stdout


def test_nothing_else_imports_the_optional_part():
    for file in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in file.parts:
            assert "tidemark.llm" not in file.read_text(), file
