"""The Python group function (KNN) must run when the driver's working
directory is not the repository (executors then cannot import the package)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
rows = E.queries()["knn_impute"](spark, "/root/testdata/sf0.001").collect()
assert len(rows) > 0 and all(r["value"] is not None for r in rows), len(rows)
print("OK", len(rows))
"""


def test_knn_runs_from_another_directory():
    with tempfile.TemporaryDirectory() as d:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        p = subprocess.run([sys.executable, "-c", SCRIPT], cwd=d, env=env,
                           capture_output=True, text=True, timeout=600)
    assert p.returncode == 0, p.stderr[-2000:]
    assert "OK" in p.stdout
