"""Exact deduplication by progressive refinement, with DataFrame operations only.

Rows are grouped by length, then by a hash of a short prefix, and only rows whose
(length, prefix hash) is shared have their whole text hashed.  Groups are counted by
partial aggregation, so a text that a third of all rows share costs one row per task;
the joins that carry decisions back have a plain exchange on both sides, so that
adaptive execution can split a hot key.  Texts are hashed where they are read: lengths, prefixes and hashes
travel, texts do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.llm import prune, scratch
from skein.llm.settle import settle
from skein.llm.text import ascii_lower, own_columns


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256, row_key.

    Texts are equal when they agree after lower-casing A-Z.  The row with the largest id
    stays.  text_sha256 is null for texts that need no whole hash, unless ``digest``.  row_key is a hash of the normalised text.

    Null text counts as empty.  A null id never wins against another; a group with null ids
    only has keep_id null and marks all of its rows as kept.  Rows that repeat both id and text are
    one document stated twice: they count in group_size and are marked alike.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    base = own_columns(docs, id_col, text_col).toDF("_id", "_text").select("_id", text.alias("_text"))
    low = ascii_lower(F.col("_text"))
    keyed = base.select("_id", "_text", F.octet_length("_text").alias("_len"), F.xxhash64(ascii_lower(F.substring("_text", 1, prefix_chars))).alias("_prefix"))

    slim = scratch.write(keyed.select("_len", "_prefix"), "exact-keys")
    lengths = scratch.write(slim.groupBy("_len").agg(F.count("*").alias("_n")).filter("_n > 1").select("_len"), "exact-lengths")
    shared = scratch.write(
        slim.join(lengths, "_len", "left_semi").groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).filter("_n > 1").select("_len", "_prefix"),
        "exact-prefixes",
    )
    may_share = prune.tester(shared.select(F.xxhash64("_len", "_prefix").alias("_key")))(F.xxhash64("_len", "_prefix"))
    whole = F.sha2(low, 256)
    tagged = keyed.select("_id", may_share.alias("_shared"), F.xxhash64(low).alias("row_key"), (whole if digest else F.when(may_share, whole)).alias("text_sha256"))
    tagged = tagged.select("_id", F.when(F.col("_shared"), F.col("text_sha256")).alias("_hash"), "row_key", "text_sha256")
    tagged = scratch.write(tagged, "exact-hashes")
    groups = scratch.write(tagged.filter("_hash is not null").groupBy("_hash").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    scratch.drop(slim, lengths, shared)

    grouped = tagged.filter("_hash is not null").join(groups, "_hash")
    alone = tagged.filter("_hash is null").select("*", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    cols = [F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "row_key"]
    return grouped.select(*cols).unionByName(alone.select(*cols))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, the one with the largest id; all columns stay.

    Of rows that repeat id and text one stays, as of rows with one text and no id; a null id
    goes where the text also has another.  Other texts under a dropped id stay.  An empty table gives an
    empty result.  Columns of any name may stand beside these.
    """
    marks = mark_exact_duplicates(docs, id_col, text_col).filter("group_size > 1").select(F.col(id_col).alias("_id"), "row_key", "kept")
    return settle(docs, id_col, F.xxhash64(ascii_lower(F.coalesce(docs[f"`{text_col}`"], F.lit("")))), marks)
