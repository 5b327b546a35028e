"""Session helpers.

The library never creates machine-local scratch paths on a cluster: the
checkpoint folder is whatever the cluster names in ``spark.checkpoint.dir``.
Only when that setting is absent *and* the master is ``local`` (tests, bench)
do we pick one under /tmp, once per process; elsewhere its absence is an error.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "12g",
}


def get_session(master: str | None = None, app: str = "estimark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  A job started by a submit command keeps the
    master and settings it was given; otherwise the session is local, with the
    settings of tests and bench."""
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    b = SparkSession.builder.appName(app)
    if master or not submitted:
        b = b.master(master or "local[*]")
    local = _LOCAL_CONF if not submitted and (master or "local").startswith("local") else {}
    for k, v in {**local, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  A local session without one gets a
    folder under /tmp; on a cluster that would be a different disk on every
    machine, so a missing setting is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="estimark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def materialize(df):
    """Cut the lineage of an intermediate that several outputs read: write it
    as a Parquet table in the shared ``spark.checkpoint.dir`` and read it back.

    One job (a checkpoint needs a second one, or a cache), survives the loss
    of executors (unlike a cache or a local checkpoint), and the read-back
    relation gets column pruning and statistics, which a checkpointed RDD
    does not."""
    spark = df.sparkSession
    path = scratch_folder(spark, "tables")
    df.write.parquet(path)
    return spark.read.parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's files under the shared checkpoint folder, which ``drop_written`` deletes."""
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/estimark-{name}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize_counted(df):
    """``materialize``, and the number of rows, counted by the write itself."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


_WRITTEN: list[str] = []


def drop_written(spark: SparkSession) -> int:
    """Delete what this process has written under ``scratch_folder``: intermediate
    tables, archives, stream logs.  Call it once the results that read them are
    stored.  Returns how many folders were deleted."""
    n = 0
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor
    (once per session), so jobs with Python stages need no ``--py-files``."""
    import shutil

    sc = spark.sparkContext
    if any(os.path.basename(f).startswith("estimark-") for f in sc._python_includes):
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    stage = tempfile.mkdtemp(prefix="estimark-ship-")  # read on the driver only, addPyFile copies it from there
    shutil.copytree(os.path.join(home, "estimark"), os.path.join(stage, "pkg", "estimark"),
                    ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(stage, f"estimark-{os.getpid()}"), "zip", os.path.join(stage, "pkg")))
