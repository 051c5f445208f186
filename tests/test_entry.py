import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_needs_no_session_and_no_llm():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0


def test_nothing_else_imports_llm():
    for p in (ROOT / "kinfold").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "kinfold").parts:
            assert "kinfold.llm" not in p.read_text(encoding="utf-8"), p
