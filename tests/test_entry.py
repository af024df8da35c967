"""The entry file where the training-data operations were deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

from checks.queries import all_queries

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_training_data_operations(tmp_path):
    """With or without corpus_pipeline.py, all other queries stay."""
    copy = tmp_path / "repo"
    without = shutil.ignore_patterns(".git", "llm", "__pycache__")
    shutil.copytree(ROOT, copy, ignore=without)
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for _ in range(2):
        run = subprocess.run([sys.executable, "-c", say], cwd=copy, capture_output=True, text=True, timeout=120)
        assert run.returncode == 0, run.stderr
        assert run.stdout.split() == [str(len(all_queries()))] * 2
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
