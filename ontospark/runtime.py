"""Session helpers: table access, the shared work folder, and size checks before a broadcast."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is proven to be below this many bytes.
BROADCAST_BYTES = 32 << 20
_local: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for an application, wherever they run and whatever their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="ontospark-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)  # the driver serves it from here
    atexit.register(lambda: os.path.exists(name) and os.remove(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        own = tempfile.TemporaryDirectory(prefix="ontospark-")
        atexit.register(own.cleanup)
        _local[app] = f"file://{own.name}"
    return _local[app]


def hadoop(spark: SparkSession, path: str):
    """The Hadoop path and its file system, so that any storage the session reads is seen, not the driver's disk."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """``(name, is a folder)`` of everything directly in a folder, by name; a missing folder holds nothing."""
    p, fs = hadoop(spark, path)
    return sorted((f.getPath().getName(), f.isDirectory()) for f in fs.listStatus(p)) if fs.exists(p) else []


_kept: dict[str, tuple] = {}


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when the driver's Python ends (a killed driver leaves it)."""
    app = spark.sparkContext.applicationId
    root = f"{shared_folder(spark)}/ontospark-{app}"
    if app not in _kept:
        _kept[app] = hadoop(spark, root)
        atexit.register(_remove, app)
    return root


def _remove(app: str) -> None:
    p, fs = _kept.pop(app, (None, None))
    try:
        if fs is not None:
            fs.delete(p, True)
    except Exception:  # the JVM has gone before; nothing can be removed any more
        pass


def release(spark: SparkSession) -> None:
    """Removes every intermediate table of the application. For long sessions, once no result that reads one is needed."""
    _remove(spark.sparkContext.applicationId)


class Stash:
    """Tables written to the shared folder to cut lineage: they outlive any executor. ``drop`` removes those no longer read, the
    others go with the application (see :func:`release`)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            p, fs = hadoop(self.spark, path)
            fs.delete(p, True)


def fits_broadcast(rows: int, bytes_per_row: int) -> bool:
    return rows * bytes_per_row <= BROADCAST_BYTES


def checked_broadcast(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """``broadcast(df)`` if its counted size is below the bound, else ``df`` as it is (a shuffle join)."""
    most = BROADCAST_BYTES // bytes_per_row
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dataset_key(column: str):
    """Datasets are compared trimmed and in lower case; null and empty mean ``default``."""
    name = F.lower(F.trim(F.col(column)))
    return F.when(name.isNull() | (name == ""), F.lit("default")).otherwise(name)
