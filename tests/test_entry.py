"""The entry module without a session, as the driver first reads it."""

import os
import subprocess
import sys


def test_entry_is_imported_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100; from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
