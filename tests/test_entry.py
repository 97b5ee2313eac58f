import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "larkspur", tmp_path / "larkspur", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) == set(e.queries()); assert 'join_filter' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "larkspur").rglob("*.py"):
        if "llm" not in path.parts:
            assert "larkspur.llm" not in path.read_text(), path
