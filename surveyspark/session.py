"""Session helpers.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a
shared folder; we only read it. Tests and the local bench build their own
session and set a checkpoint folder only when none is configured.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "surveyspark", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests / bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("SURVEYSPARK_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    try:
        v = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # noqa: BLE001 - unset key
        v = None
    return v or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset in a local run."""
    d = checkpoint_dir(spark)
    if d is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="surveyspark-ckpt-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


#: settings of a write that cuts lineage: shuffle files go when the write is done, and a projection too long for the
#: JVM to compile (over 8000 bytes of byte code) is split into methods instead of being interpreted
_STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


_SET_NOW: dict = {}             # (session, setting) -> blocks under way and the value before the first of them
_SET_LOCK = threading.Lock()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict):
    """The settings hold until the last block under way that needs them is done: threads stage at the same time."""
    with _SET_LOCK:
        for k, v in values.items():
            n, before = _SET_NOW.get((spark, k)) or (0, spark.conf.get(k, None))
            _SET_NOW[spark, k] = n + 1, before
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _SET_LOCK:
            for k in values:
                n, before = _SET_NOW.pop((spark, k))
                if n > 1:
                    _SET_NOW[spark, k] = n - 1, before
                elif before is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, before)


def staging(spark: SparkSession):
    return settings(spark, _STAGING)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a columnar copy in the shared checkpoint folder.

    Unlike a row checkpoint it is compressed, and a reader of few columns reads only those.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{name}-{uuid.uuid4().hex[:12]}"
    with staging(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``surveyspark`` importable in Python workers (pandas UDFs, mapInPandas).

    The package is zipped once per application and added with ``addPyFile``,
    which distributes it to every executor; idempotent per SparkContext.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="surveyspark-pkg-", dir="/tmp"), "surveyspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
