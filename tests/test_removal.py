"""The engine without its training-data folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["corpus_pipeline.py"], []])
def test_the_rest_stands_without_the_llm_folders(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    for name in gone:
        (tmp_path / "copy" / name).unlink(missing_ok=True)
    (tmp_path / "copy" / "pointloom" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q) and 'pipeline' not in q; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr
