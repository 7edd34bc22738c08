"""The catalogue is read before a Spark session exists."""

import subprocess
import sys

from conftest import ROOT


def test_queries_are_listed_without_a_session():
    listed = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print('op1_line_dedup' in q, 'pipeline' in q)"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert listed.stdout.split() == ["True", "True"], listed.stderr
