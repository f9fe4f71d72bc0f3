import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(len(names), 'pipeline' in names)"


@pytest.mark.parametrize("gone", [("rasterweave/llm", "tests/llm"), ("rasterweave/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, gone):
    """The driver entry answers with every other query where optional folders are left out."""
    skip = {REPO / g for g in gone} | {REPO / ".git"}

    def left_out(folder, names):
        return [n for n in names if Path(folder) / n in skip or n == "__pycache__"]

    shutil.copytree(REPO, tmp_path / "copy", ignore=left_out)
    env = {**os.environ, "PYTHONPATH": ""}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, pipeline = done.stdout.split()
    assert int(count) > 100 and pipeline == "False"
