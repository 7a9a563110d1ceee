import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_needs_no_session():
    """Queries and SQL are listed before there is a Spark session, and each SQL belongs to a query."""
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(s) >= 80 and set(s) <= set(q); print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-800:]
