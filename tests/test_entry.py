"""The entry file registers the library's queries with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import queries

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["tallyshelf/llm", "tests/llm"], ["tallyshelf/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    left_out = {ROOT / name for name in gone}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda at, names: {n for n in names if n in (".git", "__pycache__") or Path(at, n) in left_out})
    code = "import __spark_entry__ as e, bench, tests.test_plans; print(*sorted(e.queries())); print(len(set(e.oracle_sql()) - set(e.queries())))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": "."})
    assert ran.returncode == 0, ran.stderr
    names, orphans = ran.stdout.strip().split("\n")
    assert set(names.split()) >= {"top_sold", "user_sessions"} and orphans == "0"
    assert not any(n.startswith("op") and "_" in n and n[2].isdigit() or n == "pipeline" for n in names.split())


def test_all_operators_are_registered_here():
    pytest.importorskip("tallyshelf.llm.queries")
    numbers = {int(name[2:].split("_")[0]) for name in queries() if name.startswith("op") and name[2].isdigit()}
    assert numbers == set(range(1, 14)) and "pipeline" in queries()
