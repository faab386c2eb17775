"""Carries decisions about rows back to the table they were made for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.llm import prune, scratch
from skein.llm.text import free_name


def settle(docs: DataFrame, id_col: str, key: Column, marks: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``marks`` (_id, row_key, kept) does not keep, and with one of those rows that share id and key.

    ``key`` is the same hash of a row of ``docs`` as row_key.  Rows that ``marks`` does not name stay.  Only
    rows that a table of bits cannot rule out are joined; all others pass as they are.
    """
    one, two, kept, many = (free_name(docs, x) for x in ("id", "key", "kept", "many"))
    fate = marks.groupBy("_id", "row_key").agg(F.min("kept").alias("kept"), (F.count("*") > 1).alias("many")).filter("many or not kept")
    fate = scratch.write(fate, "fate")
    own = docs[f"`{id_col}`"]
    asked = prune.tester(fate.select(F.xxhash64("_id", "row_key").alias("_key")))(F.xxhash64(own, key))
    named = fate.select(F.col("_id").alias(one), F.col("row_key").alias(two), F.col("kept").alias(kept), F.col("many").alias(many))
    hit = docs.withColumn(free_name(docs, "own"), key).filter(asked)
    hit = hit.join(named, hit[f"`{id_col}`"].eqNullSafe(F.col(one)) & (hit[free_name(docs, "own")] == F.col(two)), "left")
    columns = [f"`{c}`" for c in docs.columns]
    single = hit.filter(F.col(kept).isNull() | (F.col(kept) & ~F.col(many))).select(columns)
    out = docs.filter(~asked).unionByName(single)
    if fate.filter("kept and many").isEmpty():
        return out
    return out.unionByName(hit.filter(F.col(kept) & F.col(many)).dropDuplicates([one, two]).select(columns))
