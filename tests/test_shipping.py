import os
import subprocess
import sys

from .conftest import ROOT

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
from glyspark.operators import excursions as E
df = spark.sql("SELECT 'a' AS series_id, timestampadd(MINUTE, 5 * id, timestamp_ntz'2024-01-01') AS time, cast(120 + 60 * sin(id / 9) AS int) AS glucose FROM range(300)")
print("points", E.turning_points(df).count())
"""


def test_workers_get_the_code_without_a_path(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "points" in out.stdout, out.stderr[-2000:]
