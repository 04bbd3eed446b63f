"""Python-worker stages must work when the driver runs outside the repository
(the package is shipped to the workers, not found on their path by accident)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from keelson.operators.knn import knn
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, v array<double>")
print("NEIGHBOURS", knn(df, df, 2, "id", "v", "id", "v").count())
spark.stop()
"""


def test_worker_imports_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="keelson-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert "NEIGHBOURS 40" in out.stdout, out.stderr[-2000:]
