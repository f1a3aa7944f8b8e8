"""Session settings, and reading the tables of a data folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "tidemark", **conf: object) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow, for tests, the command line and the bench.

    Of members of one name in a JSON object, the last counts; without that setting such objects are no JSON to Spark.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that is not there yet, for tables that a job writes and reads again.

    It is within the shared folder that the cluster names in spark.checkpoint.dir; only a session on one machine that
    has no such setting, as in tests, takes a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of a session, once: as a zip of its code that executors fetch from the driver.

    Operators that run Python call it, so that only the driver needs the package on its path. The zip, code and no
    data, lies on the driver until it ends.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(os.path.join(folder, "tidemark.zip"), "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(os.path.join(folder, "tidemark.zip"))
    _shipped.add(sc.applicationId)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
