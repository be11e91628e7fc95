"""The entry point without the optional operators: imports, and runs the rest."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

RUN = """
import __spark_entry__ as E
names = set(E.queries())
assert "polarity_counts" in names and "pipeline" not in names and not any(n.startswith("op") for n in names), names
assert set(E.oracle_sql()) <= names
from tagwright.session import local_session
assert E.entry(local_session(2)).count() == 3
"""


def _copy(tmp_path, *left_out):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "tagwright"):
        if name in left_out or not os.path.exists(os.path.join(ROOT, name)):
            continue
        if name.endswith(".py"):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
        else:
            shutil.copytree(os.path.join(ROOT, name), tmp_path / name,
                            ignore=shutil.ignore_patterns("__pycache__", "llm"))


def _run(tmp_path):
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry_without_optional_operators(tmp_path):
    _copy(tmp_path)
    _run(tmp_path)


def test_entry_without_optional_operators_and_pipeline(tmp_path):
    _copy(tmp_path, "corpus_pipeline.py")
    _run(tmp_path)
