"""Session, checkpoint and size helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "kinweave", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a private one only where that setting is absent and the master
    is local. On a cluster a folder of one machine would be read by no other, so there the setting is required."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kinweave-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def work_folder(spark: SparkSession) -> str:
    """This application's part of the checkpoint folder, deleted when the driver ends."""
    sc = spark.sparkContext
    folder = f"{ensure_checkpoint_dir(spark)}/kinweave-{sc.applicationId}"
    if getattr(sc, "_kw_folder", None) != folder:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        sc._kw_folder = folder
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared checkpoint folder, which survives the loss of executors.

    A written table, unlike a checkpointed plan, carries no inferred constraints along; in long loops those grow
    without bound. It also brings exact sizes for the planning of the next joins.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kw_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for files of this application in the shared folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(*frames: DataFrame) -> None:
    """Delete checkpoint tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_kw_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            df._kw_path = None


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint behind a count of at most max_rows + 1 rows; a larger side is left to a shuffle join.

    The count stops at the bound (limit), so the check itself stays cheap at any size.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """df for work on whole texts: a scan of fewer splits than there are cores is dealt out to all of them; a larger one
    stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable_hash(*cols: Column | str) -> Column:
    """A deterministic 64-bit hash of the columns."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def unused(base: str, *frames: DataFrame) -> str:
    """A column name near base that no frame uses."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name
