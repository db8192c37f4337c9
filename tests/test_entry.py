"""The entry point with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return set(out.stdout.split())


def test_entry_point_without_the_training_data_operators(tmp_path):
    """Without their folder, with and without the pipeline over them, the other queries are there."""
    full = names(ROOT)
    if os.path.isdir(os.path.join(ROOT, "cohortweave", "llm")):
        assert "pipeline" in full and len([n for n in full if n.startswith("op")]) == 13
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "a", ignore=skip)
    rest = names(tmp_path / "a")
    assert rest == {n for n in full if n != "pipeline" and not n.startswith("op")}
    (tmp_path / "a" / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(tmp_path / "a") == rest
