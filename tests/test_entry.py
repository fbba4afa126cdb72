"""The entry module without the training-data operators, or without a library of theirs."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(code: str) -> set[str]:
    run = subprocess.run([sys.executable, "-c", code + "; import __spark_entry__ as e; print(' '.join(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    return set(run.stdout.split())


def test_without_a_library():
    whole = names("pass")
    assert names("import sys; sys.modules['ahocorasick'] = None") == whole


def test_without_the_subpackage():
    rest = names("import sys; sys.modules['siltstone.llm'] = None")
    assert "flagship_gate_by_source" in rest and not any(n.startswith("op") for n in rest) and "pipeline" not in rest
