"""Cuts of lineage, and results of steps that a later run takes up again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set and all runs on one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="skein-"))
    return conf.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: other executors can read it when the one that made it is lost."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def step(spark: SparkSession, folder: str, name: str, make) -> DataFrame:
    """The table of a finished step of a run, or the one that ``make()`` gives, written first.

    A step counts as finished when the writer's success mark is there, so a run that was
    stopped goes on after its last whole step.
    """
    path = f"{folder.rstrip('/')}/{name}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
