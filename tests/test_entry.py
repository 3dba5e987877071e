"""The driver's entry: importable without a session and without its optional parts."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def names(folder) -> list[str]:
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def test_imports_without_a_session():
    assert "common_transitions" in names(ROOT)


def test_works_without_the_optional_parts(tmp_path):
    shutil.copytree(os.path.join(ROOT, "kvtrail"), tmp_path / "kvtrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    found = names(tmp_path)
    assert "common_transitions" in found and "pipeline" not in found


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
