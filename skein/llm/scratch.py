"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage and survives lost executors: a later stage that is
retried reads the files again and does not recompute what stood before them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_LIVE: dict[str, weakref.ref] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="skein-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex[:12]}"
    _LIVE[path] = weakref.ref(spark)
    return path


def write(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns the table read back.

    Shuffle files of the write go when it is done: what comes later reads the table, not them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._skein_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read any more."""
    for table in tables:
        path = getattr(table, "_skein_path", None)
        if path:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    _LIVE.pop(path, None)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, ref in list(_LIVE.items()):
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
