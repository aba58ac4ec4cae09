"""Workers need not have the package on their path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spec = importlib.util.spec_from_file_location("__spark_entry__", "{REPO}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in ("op3_spaced_seeds", "op10_gru_lm", "op12_digest_index", "op13_spelling_variants"):
    print(name, entry.queries()[name](spark, "{SF}").count())
import corpus_pipeline
docs, stages = spark.read.parquet("{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
print("kept", stages["benchmark decontamination"](spark, docs, "{SF}").count())
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "kept" in done.stdout
