"""Nothing outside the subpackage for corpora needs it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_imports_the_subpackage():
    for f in [*ROOT.glob("codonflow/**/*.py")]:
        if "llm" not in f.relative_to(ROOT).parts:
            text = f.read_text()
            assert "codonflow.llm" not in text and "from .llm" not in text and "from ..llm" not in text, f


def test_entry_without_it(tmp_path):
    for f in [ROOT / "__spark_entry__.py", *ROOT.glob("codonflow/**/*.py")]:
        own = f.relative_to(ROOT)
        if "llm" not in own.parts:
            (tmp_path / own).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / own).write_text(f.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n); assert set(e.oracle_sql()) <= set(n)"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
