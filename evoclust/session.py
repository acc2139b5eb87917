"""Session helpers: local session for tests/bench, shared checkpoint folder."""

from __future__ import annotations

import functools
import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "evoclust") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the cluster; only where it is
    unset (tests, a laptop) a scratch folder is created and set.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir()
    if hasattr(path, "isDefined"):  # scala Option
        path = path.get() if path.isDefined() else None
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="evoclust-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return str(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub folder of the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage (and keeps the size estimate honest) for iterative loops;
    survives the loss of executors because the files are on shared storage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if getattr(_SCOPES, "open", None):
        _SCOPES.open[-1].append(path)
    return spark.read.parquet(path)


_SCOPES = threading.local()


@contextmanager
def cuts_removed(spark: SparkSession):
    """Removes, at its end, the folders that ``cut`` wrote inside it."""
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def tidy(fn):
    """A function whose DataFrame is written at once, so that the folders it
    cut on the way can go."""
    @functools.wraps(fn)
    def run(df: DataFrame, *args, **kw) -> DataFrame:
        spark = df.sparkSession
        path = scratch_path(spark, fn.__name__)
        with cuts_removed(spark):
            fn(df, *args, **kw).write.mode("overwrite").parquet(path)
        if getattr(_SCOPES, "open", None):
            _SCOPES.open[-1].append(path)
        return spark.read.parquet(path)
    return run


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers (``--py-files``).

    The package is zipped in memory once per application, written to the
    shared checkpoint folder through the Hadoop file system, and registered
    with ``addPyFile`` so Spark serves it to every executor.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import hashlib
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in sorted(os.walk(pkg_dir)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("evoclust", os.path.relpath(full, pkg_dir)))
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:12]
    root = ensure_checkpoint_dir(spark)
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(os.path.join(root, "evoclust-pyfiles", f"evoclust-{digest}.zip"))
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(key)
