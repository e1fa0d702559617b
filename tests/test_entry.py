"""The entry must work with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("gone", [(), ("siftline/llm",), ("corpus_pipeline.py",), ("siftline/llm", "corpus_pipeline.py")])
def test_entry_without(tmp_path, gone):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    shutil.copytree(REPO, tmp_path / "repo", ignore=skip)
    for name in gone:
        path = tmp_path / "repo" / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    every, with_sql, optional = map(int, done.stdout.split())
    assert every > 130 and with_sql > 100
    if "siftline/llm" in gone:
        assert optional == 0
