"""Text operators run where only the driver has the package on its path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
CODE = """
import sys
sys.path.insert(0, {root!r})
from tidemark.llm import queries
from tidemark.session import build_session
spark = build_session("local[2]", "elsewhere")
spark.sparkContext.setLogLevel("ERROR")
print("rows", queries.p8_ids(spark, {data!r}).count(), queries.p9_found(spark, {data!r}).count())
"""


def test_ids_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), data=DATA)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 100 7" in done.stdout, done.stderr[-2000:]
