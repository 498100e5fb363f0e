"""The driver's contract."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_imports_without_a_session_and_without_the_llm_folder(tmp_path):
    for name in ("tomeforge", "jobs", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    for gone in (False, True):
        if gone:
            shutil.rmtree(tmp_path / "tomeforge/llm", ignore_errors=True)
        code = "import __spark_entry__ as e; print(len(e.queries()) > 90, any(n.startswith('op') for n in e.queries()))"
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
        assert said.stdout.split() == ["True", str(not gone and os.path.isdir(f"{ROOT}/tomeforge/llm"))], said.stderr
