"""Session helpers: a tuned local/cluster session and a shared scratch folder.

Scratch data (checkpoints, fixture files, chunk output) always lives under the
folder the cluster names in ``spark.checkpoint.dir``. Only when that setting is
absent (tests, a laptop) do we create a folder of our own and register it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "sluice",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with AQE on, UI off, UTC, Arrow on. ``master`` None keeps the cluster's."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        # local mode: the driver JVM is the whole cluster; its heap is the only knob
        conf["spark.driver.memory"] = os.environ.get("SLUICE_DRIVER_MEMORY", "12g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; registers a private one only if none is set."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="sluice-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path under the shared checkpoint folder (not created)."""
    root = checkpoint_root(spark)
    # the registered checkpoint dir gets a uuid sub-folder; siblings of it are shared too
    base = root.rstrip("/")
    return f"{base}/sluice-{name}-{uuid.uuid4().hex[:12]}"


def staged(df, name: str):
    """Write to the shared scratch folder and read back: later passes read rows, not the work that made them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the cluster's default file system, if it names none: executors that open
    it themselves must not take it for a folder of their own."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python-side writers (pyarrow.fs) can use the path."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def ensure_dir(path: str) -> None:
    p = local_path(path)
    if "://" not in p:
        os.makedirs(p, exist_ok=True)
