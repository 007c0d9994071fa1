"""Python tasks must not need the package on the executors' path."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from __spark_entry__ import queries
q = queries()
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", q["x16_centroid_distance"](spark, sys.argv[2]).count())
from kinetable.operators.safety import partial_block
df = spark.createDataFrame([(1, "a badw0rd here")], "id int, text string")
print("hits", partial_block(df, ["badword"], "id", slack=1.0).count())
"""


def test_tasks_run_without_the_package_on_their_path(tmp_path, sf_dir):
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", CODE, root, sf_dir], cwd=tmp_path, capture_output=True, text=True, timeout=240,
    )
    assert "hits 1" in done.stdout and "rows " in done.stdout, done.stderr[-2000:]
