"""The training-data operators are apart: nothing else imports them."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for p in ROOT.glob("eventloom/**/*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"(from|import) +\S*\bllm\b", p.read_text()), p


def test_entry_works_without_llm(tmp_path):
    code = "import sys; sys.modules['eventloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True)
