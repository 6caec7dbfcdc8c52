"""The library without its optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    for folder in ("with pipeline", "without pipeline"):
        code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert len(q) > 100 and 'pipeline' not in q and set(o) <= set(q) and not any(n.startswith('op') for n in q)"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
        assert done.returncode == 0, (folder, done.stderr)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
