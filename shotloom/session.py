"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "shotloom", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes.

    ``master`` stays unset on a cluster so that spark-submit decides.  Shuffle
    partitions are left to adaptive execution: a high initial number that is
    coalesced at run time, so that one setting serves small and large inputs.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Only a local session may go without: it gets a temporary folder.  Anywhere else the
    executors would write to their own disks, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, and read it back.

    Ordered operators visit their input more than once; without this a chain of them
    would repeat all earlier work at every step.  The table lives in the shared
    checkpoint folder, so it also survives the loss of an executor, and being columnar
    it still allows column pruning.  ``release`` removes it.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"stage-{uuid.uuid4().hex}")
    # the shuffle files behind a written table are of no more use
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    back = spark.read.schema(df.schema).parquet(path)
    back.stage_path = path
    return back


def release(*staged: DataFrame) -> None:
    """Remove staged tables that no later result reads."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
