"""Session helpers: a builder with the settings the library expects, and worker imports."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(app: str = "millrace", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; extra settings by keyword (dots as ``__``)."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed (local runs, shared mounts).

    On a cluster install the package on the executors or pass it with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH"), os.environ.get("PYTHONPATH")) if p]
    have = ":".join(paths).split(":")
    if ROOT not in have:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


#: Rows of an Arrow batch: texts may be long, and a batch is held whole by both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Unless the session has its own choice, send texts to Python in batches of BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset in local mode (tests) a temporary one of our own."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d
