"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs rely on. All of them are ordinary Spark options.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "framesift", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with `SESSION_CONF` applied; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in SESSION_CONF.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="framesift-code-"), "framesift")
        sc.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(sc.applicationId)
    return spark


#: Tasks per core that read files, at most.
READ_TASKS_PER_CORE = 8


def reading_tasks(spark: SparkSession) -> int:
    """How many tasks read very many small files: by the cores or the shuffle's partitions, not by the files."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), READ_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, since there the
    driver's disk is the executors' disk. On a cluster a missing setting is an
    error: a machine-local folder would lose the data with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="framesift-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def new_name(label: str) -> str:
    return f"{label}-{uuid.uuid4().hex}"


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{new_name(label)}"


def drop_shared_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of `new_shared_path` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so it outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
