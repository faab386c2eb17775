"""A run watched while it goes: node rows that arrive as files, as a stream of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.operators.run_state import status

NODE_SCHEMA = "run string, location string, kind string, started timestamp, finished timestamp, error string"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """Latest state of each node, updated as files arrive in ``folder``.

    Each update adds to what is known of a node, in any order, however long it ran: state is one row for each
    node of the runs watched, and none is given up while the watch lasts.
    """
    rows = spark.readStream.schema(NODE_SCHEMA).parquet(folder)
    newest = rows.groupBy("run", "location").agg(F.max("started").alias("started"), F.max("finished").alias("finished"), F.max("error").alias("error"), F.max("kind").alias("kind"))
    return newest.withColumn("status", status())
