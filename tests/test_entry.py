"""The entry without the parts that can be taken away."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len([n for n in e.queries() if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline']), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.fixture
def rest(tmp_path):
    skip = shutil.ignore_patterns("llm", "__pycache__", "corpus_pipeline.py")
    shutil.copytree(REPO / "shelfmark", tmp_path / "shelfmark", ignore=skip)
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    return tmp_path


def run(folder):
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True)


def test_queries_without_the_optional_part(rest):
    assert run(rest).stdout == "0 True\n"


def test_a_broken_optional_part_is_not_hidden(rest):
    (rest / "shelfmark/llm").mkdir()
    (rest / "shelfmark/llm/__init__.py").write_text("")
    (rest / "shelfmark/llm/queries.py").write_text("import no_such_module\n")
    out = run(rest)
    assert out.returncode and "no_such_module" in out.stderr
