"""Connected components of a table of links, by joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.llm import scratch


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node it reaches.

    Each round a node takes the least label among its own and its neighbours', and then the label
    of its label, so that a path of n links needs about log n rounds.  Labels are written
    to the shared folder after each round.  Self-links and repeated links are harmless; null ends
    are ignored; no links give no rows.
    """
    links = links.filter("a is not null and b is not null")
    both = scratch.write(links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a")).distinct(), "cc-links")
    label = scratch.write(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("comp")), "cc-labels")
    for _ in range(max_rounds):
        told = both.join(label.select(F.col("node").alias("near"), "comp"), "near").groupBy("node").agg(F.min("comp").alias("heard"))
        told = scratch.write(label.join(told, "node").select("node", F.least("comp", "heard").alias("comp"), F.col("comp").alias("old")), "cc-heard")
        of = told.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = scratch.write(told.join(of, "comp").select("node", F.least("comp", "root").alias("comp"), "old"), "cc-labels")
        changed = new.filter("comp <> old").limit(1).count()
        scratch.drop(label, told)
        label = new.select("node", "comp")
        label._skein_path = new._skein_path
        if not changed:
            scratch.drop(both)
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
