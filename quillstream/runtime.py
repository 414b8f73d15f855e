"""Session-level helpers: scratch tables in the shared folder, and broadcasts behind a size check."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and estimated bytes up to which a side may be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session, or, in local mode only, a temporary one where it is unset."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quillstream-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


_tables: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there stays until `drop_scratch` or the end of the program."""
    path = f"{shared_dir(spark)}/quillstream/{name}-{uuid.uuid4().hex[:12]}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path


#: Whether a query that has ended gives its shuffle files back.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives its shuffle files back once it is written; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def materialize(df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage and survives the loss of an executor.  The files stay
    until `drop_scratch` or the end of the program, since the caller may still
    evaluate frames that read them.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_released(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables `materialize` wrote in this session; frames that read them become invalid."""
    jvm = spark.sparkContext._jvm
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, row_bytes: int, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised df is within the bound for broadcasting; counts at most bound + 1 rows."""
    most = min(rows, size // max(1, row_bytes))
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, row_bytes: int = 64, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for broadcasting if it was counted to be within the bound; else leave the join to a shuffle with AQE."""
    return F.broadcast(df) if small(df, row_bytes, rows, size) else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="quillstream-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "quillstream.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path, _, names in os.walk(os.path.join(root, "quillstream")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(path, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
