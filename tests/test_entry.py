"""The entry module from a foreign working folder, and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
print("ROWS", entry.queries()["corpus_bleu"](spark, {sf_dir!r}).count(), entry.entry(spark).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_workers_find_the_package_from_anywhere(tmp_path):
    script = SCRIPT.format(repo=REPO, shared=str(tmp_path / "shared"), sf_dir=SF_DIR)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS 4 1827" in out.stdout, out.stderr[-2000:]


def test_library_stands_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(REPO, "codemix"), tmp_path / "codemix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    script = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)},
                         capture_output=True, text=True, timeout=300)
    count, numbered, pipeline = out.stdout.split()
    assert int(count) > 80 and numbered == "False" and pipeline == "False", out.stderr[-2000:]
