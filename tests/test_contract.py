"""The contract must import anywhere, also where Spark's jars are out of sight."""

import subprocess
import sys

from conftest import ROOT

CODE = """
import pyspark, sys
pyspark.__file__ = sys.argv[1] + "/__init__.py"
import __spark_entry__ as contract
assert contract.oracle_sql() and contract.queries()
"""


def test_import_reads_no_file_beside_pyspark(tmp_path):
    run = subprocess.run(
        [sys.executable, "-c", CODE, str(tmp_path)], cwd=ROOT, capture_output=True, text=True
    )
    assert run.returncode == 0, run.stderr
