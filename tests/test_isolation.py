"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_works_without_the_subpackage(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(HERE, there, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); assert set(o) <= set(q) and len(q) > 50; print('fine')"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=there, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip() == "fine", got.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(HERE, "voxloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "llm" not in text.read(), f
