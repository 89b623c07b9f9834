"""The entry points with and without the subpackage that may be taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
LOOK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), *sorted(set(o) - set(q))); print(*sorted(q))"


def _look(at):
    got = subprocess.run([sys.executable, "-c", LOOK], cwd=at, capture_output=True, text=True, check=True, timeout=300)
    return got.stdout.splitlines()[-2:]


def test_without_the_subpackage(tmp_path):
    from seamark.plans.queries import QUERIES

    shutil.copytree(ROOT / "seamark", tmp_path / "seamark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for left in (False, True):
        count, names = _look(tmp_path)
        assert count == str(len(QUERIES)) and names.split() == sorted(QUERIES)
        if not left and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
