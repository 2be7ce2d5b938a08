"""What the operators of this subpackage share: scratch tables, column guards and 64-bit mixing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import importable, small_batches

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, one of our own in local mode."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, own, True)
        d = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def cut(df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(spark: SparkSession) -> None:
    """Let the session clean up after jobs that have ended: their shuffle files go once the driver's references are
    collected. It holds on to the last query until another has run, hence the small one."""
    spark.range(1).count()
    spark.sparkContext._jvm.java.lang.System.gc()


def sweep() -> None:
    """Delete the scratch tables made so far (called at exit; call it earlier once the results are written)."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):
            drop(spark, path)


atexit.register(sweep)


def give_back() -> None:
    """Return what a Python worker has freed to the system: it idles on while later stages need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names cannot matter."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(col: str, m: int) -> F.Column:
    """crc32 of the value as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values (the murmur3 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
