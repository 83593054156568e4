"""The driver's entry file with and without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def names_of(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return [int(n) for n in out.stdout.split()]


def test_entry_works_without_the_text_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    queries, statements = names_of(tmp_path / "repo")
    assert queries == statements > 100


def test_a_broken_import_is_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    part = tmp_path / "repo" / "orderlens" / "llm"
    if not part.exists():
        return
    (part / "shared.py").write_text("import no_such_module_at_all\n")
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert run.returncode and "no_such_module_at_all" in run.stderr
