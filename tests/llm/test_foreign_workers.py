"""Every corpus query and the pipeline in a session whose Python workers can't import this package: functions travel by value."""

import os
import subprocess
import sys

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[3]).config("spark.sql.warehouse.dir", sys.argv[3] + "/w").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def cannot(_):
    try:
        import recollect
        return ["importable"]
    except ImportError:
        return ["not importable"]

print(spark.sparkContext.parallelize([0], 1).flatMap(cannot).collect())
from recollect.llm import queries, similar
every = dict(queries.queries())
docs = spark.read.parquet(sys.argv[2] + "/documents.parquet")
# many close fingerprints, so that meetings of three and more come up
near = docs.limit(30).selectExpr("explode(sequence(0, 9)) AS k", "doc_id", "text").selectExpr("doc_id * 10 + k AS doc_id", "concat(text, ' word', k) AS text")
every["near"] = lambda s, d: similar.similar_rows(near)
try:
    import corpus_pipeline
    every["pipeline"] = corpus_pipeline.run
except ImportError:
    pass
for name, query in every.items():
    print(name, query(spark, sys.argv[2]).count() > 0, flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    tokenizers = next((p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if os.path.exists(os.path.join(p, "public_tokenizers.py"))), None)
    if tokenizers:
        env["PYTHONPATH"] = tokenizers
    done = subprocess.run([sys.executable, "-c", RUN, REPO, SF, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True)
    lines = done.stdout.split("\n")
    assert lines[0] == "['not importable']", done.stderr[-2000:]
    assert done.returncode == 0, done.stderr[-3000:]
    assert all(x.endswith(" True") for x in lines[1:] if x), done.stdout
