"""The entry points and the market half without the corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["marketlens/llm"], ["corpus_pipeline.py"], ["marketlens/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *(Path(g).name for g in gone)))
    code = "import __spark_entry__ as e; print(sorted(e.queries())); print(set(e.oracle_sql()) <= set(e.queries()))"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # else the original could be found there
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=clean, capture_output=True, text=True, check=True).stdout
    assert "'top_brands'" in out and "'pipeline'" not in out and "True" in out
    there = (ROOT / "marketlens/llm/queries.py").exists()
    assert ("op3_exact_dedup" in out) == (there and gone == ["corpus_pipeline.py"])
