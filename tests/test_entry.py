"""The entry points hold without the subpackage, which may be deleted."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert q and set(o) <= set(q), set(o) - set(q); print(sum(n.startswith('op') for n in q), 'pipeline' in q)"


def probe(where):
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=where, env=os.environ | {"PYTHONPATH": str(where)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name.endswith(".py"):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "logloom"), tmp_path / "logloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert probe(tmp_path) == ["0", "False"]
