"""A query with a Python function, started from a folder that doesn't hold the package."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = f"""
import sys
sys.path.insert(0, {HOME!r})
from seqweft.session import build_session
import __spark_entry__ as entry
spark = build_session("local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
print("rows", entry.queries()["g2_band_energy"](spark, {SF!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
