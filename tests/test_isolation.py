"""The library without its training-data operators: entry points work, with the other queries alone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q))"


@pytest.mark.parametrize("without", [("corpus_pipeline.py",), ()])
def test_entry_without_llm(tmp_path, without):
    """Also where corpus_pipeline.py is still there."""
    from provenia.queries import QUERIES

    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "__pycache__", *without)])
    assert not (to / "provenia/llm").exists() and not (to / "tests/llm").exists()
    said = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=to, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(QUERIES)), "False", "False"]


def test_nothing_else_imports_llm():
    for f in (ROOT / "provenia").rglob("*.py"):
        assert "llm" in f.relative_to(ROOT).parts or "provenia.llm" not in f.read_text(), f


def test_entry_without_a_library_of_llm(tmp_path):
    """The files are there, but what they import isn't."""
    from provenia.queries import QUERIES

    if not (ROOT / "provenia/llm").exists():
        pytest.skip("no training-data operators here")
    (tmp_path / "regex.py").write_text("raise ImportError('not installed')")
    said = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=ROOT, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(QUERIES)), "False", "False"]
