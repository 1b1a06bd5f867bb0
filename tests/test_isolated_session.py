"""The driver's own session, started outside the repository, can run the
queries whose code executes in Python workers (folds, stateful processors)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
q = E.queries()
for key in ["admit_purchases", "stream_admit_attends"]:
    print(key, q[key](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""


def test_worker_code_needs_no_installed_package():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as cwd:
        done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                              timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.strip())
    assert int(counts["admit_purchases"]) == 6000 and int(counts["stream_admit_attends"]) > 0
