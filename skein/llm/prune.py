"""A filter of fixed size that goes to the scan, ahead of a join that would shuffle whole texts.

The keys of the smaller side set bits in a table of 2**20 bits (128 KB, whatever the data).  Rows
whose bit is not set cannot join and are not shuffled.  Where keys are so many that most bits
are set it spares nothing; the join after it gives the same rows in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 20
_WORDS = 1 << (BITS - 6)


def _place(key: Column) -> tuple[Column, Column]:
    h = F.xxhash64(key).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.shiftright(h, 6).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def tester(keys: DataFrame):
    """A function of a key column: whether it may be among ``keys`` (one column); null never is."""
    word, bit = _place(F.col(keys.columns[0]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    found = {r["w"]: r["b"] for r in keys.select(word.alias("w"), one.alias("m")).groupBy("w").agg(F.bit_or("m").alias("b")).collect()}  # _WORDS rows at most
    table = F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(_WORDS))), ",").cast("array<bigint>")

    def test(key: Column) -> Column:
        word, bit = _place(key)
        return key.isNotNull() & (F.call_function("bit_get", F.get(table, word), bit) == 1)

    return test


def may_join(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys``; null keys go."""
    return df.filter(tester(keys)(F.col(key)))
