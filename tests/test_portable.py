"""The entry module works from any folder, without PYTHONPATH and without the
Spark jars folder being listable, and ships the package to Python workers."""
import os
import subprocess
import sys

from conftest import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import glob, sys
glob.glob = lambda *a, **k: []
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
q, sql = E.queries(), E.oracle_sql()
assert len(q) >= 60 and len(sql) >= 60
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
for name in ("cosine_top_k_block", "pair_lcs", "remove_stop_words"):
    print(name, q[name](spark, {SF001!r}).count())
"""


def test_entry_from_another_folder():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd="/", env=env, timeout=300,
                       capture_output=True, text=True)
    assert r.returncode == 0, r.stderr[-2000:]
    assert r.stdout.count("\n") >= 3
