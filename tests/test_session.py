"""The package on workers, and folders."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tidemark.session import new_folder

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
from tidemark.operators.transforms import filter_python
from tidemark.functions.durations import parse_duration_ms
from tidemark.session import build_session
spark = build_session("local[2]", "elsewhere")
spark.sparkContext.setLogLevel("ERROR")
print("rows", filter_python(spark.range(10), lambda r: r["id"] * 1000 > parse_duration_ms("5s")).count())
"""


def test_workers_have_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 4" in done.stdout, done.stderr[-2000:]


class Session:
    """A session's settings and master."""

    def __init__(self, master, **conf):
        self.sparkContext, self.conf = SimpleNamespace(master=master), SimpleNamespace(get=lambda key, default: conf.get(key, default))


def test_new_folders_are_in_the_shared_one(spark, tmp_path):
    shared = {"spark.checkpoint.dir": f"file://{tmp_path}/shared"}
    assert new_folder(Session("spark://host", **shared), "x").startswith(f"file://{tmp_path}/shared/x-")
    with pytest.raises(ValueError, match="checkpoint"):
        new_folder(Session("spark://host"), "x")
    assert new_folder(spark, "x") != new_folder(spark, "x")
