import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_can_be_read_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); print(len(q))"
    r = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-500:]


def test_core_does_not_import_the_training_data_operators():
    for p in (ROOT / "quillet").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "quillet.llm" not in p.read_text(), p
