"""UDFs must not need the package on the workers' import path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
assert e.queries()["xcorr"](spark, "/root/testdata/sf0.001").count() > 0
assert len(e.queries()["ipc_scan"](spark, "/root/testdata/sf0.001").collect()) > 0
assert e.queries()["network_scoring"](spark, "/root/testdata/sf0.001").agg({{"calibrated_confidence": "max"}}).first()[0] > 0
"""


def test_udfs_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
