"""The driver's entry, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = sorted(e.queries())
assert set(e.oracle_sql()) <= set(names)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert e.queries()["occupancy_map"](spark, "/root/testdata/sf0.001").count() == 900
print("NAMES", len(names), sum(n[:2] == "op" and n[2:3].isdigit() or n == "pipeline" for n in names))
"""


@pytest.mark.parametrize("gone", [["nichemap/llm", "tests/llm"], ["nichemap/llm", "tests/llm", "corpus_pipeline.py"]])
def test_queries_without_the_text_operators(tmp_path, gone):
    for name in ("nichemap", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        if os.path.exists(source):
            (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, target)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        (tmp_path / name).unlink(missing_ok=True) if not (tmp_path / name).is_dir() else None
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    from nichemap import queries

    assert f"NAMES {len(queries.QUERIES)} 0" in out.stdout
