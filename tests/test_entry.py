"""The entry module in a process of its own, as the driver imports it: no session is there yet."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(code: str) -> str:
    env = {**os.environ, "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, env=env, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_import_without_session():
    out = run("import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))")
    n, known = out.split()
    assert int(n) >= 40 and known == "True"


def test_import_without_optional_packages():
    """Without the subpackage's own needs the rest still registers."""
    out = run("import sys; sys.modules['matforge.llm'] = None\nimport __spark_entry__ as e; print(any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()), 'catalog_clean' in e.queries())")
    assert out.split() == ["False", "True"]


def test_an_error_inside_the_subpackage_is_not_hidden():
    """A name that the subpackage imports and that is not there stops the import; a missing package does not."""
    out = run("import sys, types; sys.modules['matforge.llm.queries'] = types.ModuleType('matforge.llm.queries')\nimport __spark_entry__ as e\ntry:\n    e.queries()\nexcept ImportError as x:\n    print(type(x).__name__)")
    assert out.split() == ["ImportError"]
    out = run("import sys; sys.modules['tokenizers'] = None; sys.modules['duckdb'] = None\nimport __spark_entry__ as e; print('catalog_clean' in e.queries())")
    assert out.split() == ["True"]
