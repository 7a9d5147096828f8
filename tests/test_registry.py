"""The registry can be read where no session runs."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 200; from pyspark import SparkContext as c; assert c._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
