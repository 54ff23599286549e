"""The entry point with and without the optional folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parent.parent


def test_without_optional_folders(tmp_path):
    shutil.copy(HOME / "__spark_entry__.py", tmp_path)
    shutil.copytree(HOME / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    queries, sql, optional = said.stdout.split()
    assert int(queries) >= int(sql) > 60 and optional == "False"


def test_library_doesnt_import_them():
    for path in (HOME / "lectern").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lectern.llm" not in path.read_text(), path
