"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "plumbline", memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the cluster's own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local session may fall back
    to a temporary folder, because executors of a cluster cannot see the driver's disk."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a block-manager copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fetched_file(spark: SparkSession, write: Callable[[str], None]) -> str:
    """Name of a file that ``write(path)`` makes on the driver and every executor fetches once; tasks find it by ``SparkFiles.get(name)`` and may map it."""
    folder = tempfile.mkdtemp(prefix="plumbline-shared-")
    atexit.register(shutil.rmtree, folder, True)  # executors may fetch it as long as the session lives
    name = uuid.uuid4().hex
    write(os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input has fewer splits than the session has cores, ahead of work that
    is heavy per row. A large input has enough splits and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
