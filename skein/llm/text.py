"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ``lower`` is quick and right for pure ASCII; ``translate`` serves the rest."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def own_columns(df, *names: str):
    """Only the columns an operator reads, so that clashing extra columns cannot meet its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name
