from __future__ import annotations

import subprocess
import sys

from conftest import ROOT


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 250 and set(o) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
