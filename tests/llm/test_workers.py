"""Executors that lack this package: only the driver's path has it."""

import os
import subprocess
import sys

import pytest

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {tmp!r}).getOrCreate()

def lacks(_):
    try:
        import umbral
    except ImportError:
        yield "lacks"

assert spark.sparkContext.parallelize([0], 1).mapPartitions(lacks).collect() == ["lacks"]
from umbral.llm.queries import QUERIES
for name in {names!r}:
    assert QUERIES[name](spark, {sf!r}).count() > 0, name
print("done")
"""


@pytest.mark.parametrize("names", [["op1_decontaminate", "op2_bpe", "op3_language"], ["op4_simhash", "op9_html", "op10_topk"], ["op7_lm"]])
def test_workers_need_not_have_the_package(sf, tmp_path, names):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=repo, sf=sf, tmp=str(tmp_path / "work"), names=names)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.strip().endswith("done"), done.stderr[-3000:]
