"""The entry point with and without the training-data operators."""

import pathlib
import shutil
import subprocess
import sys

import pytest

REPO = pathlib.Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'op1_secrets' in q, set(e.oracle_sql()) <= set(q))"


@pytest.fixture
def copy(tmp_path):
    """The package and the entry point, without the operators and their pipeline."""
    shutil.copytree(REPO / "urlrisk", tmp_path / "urlrisk", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    return tmp_path


def ask(folder):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(folder)})


def test_without_the_operators(copy):
    said = ask(copy)
    count, found, matched = said.stdout.split()
    assert int(count) > 150 and (found, matched) == ("False", "True")
    (copy / "urlrisk" / "llm").mkdir()  # a folder that was left behind
    assert ask(copy).stdout == said.stdout


def test_something_missing_is_not_hidden(copy):
    (copy / "urlrisk" / "llm").mkdir()
    (copy / "urlrisk" / "llm" / "__init__.py").write_text("")
    (copy / "urlrisk" / "llm" / "queries.py").write_text("import a_package_that_is_not_there\n")
    assert "a_package_that_is_not_there" in ask(copy).stderr
