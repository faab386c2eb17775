"""Variable-capacity best-fit packing of documents into training sequences.

Lengths, never texts, are dealt at random to shards of bounded size, and each shard
is packed on its own.  Pieces go by falling length into the open bin with the least room
that holds them.  Where none does, a bin opens.  All permitted sizes compete for it: what the lengths
still to be placed could add to the piece is told from their histogram, and the size whose cost for each token
so expected is least wins.  At the end each bin shrinks to the smallest permitted size that holds it.

The cost of a sequence has a fixed part, one for each place and one that grows with the square
of its size, as attention does.  So short sequences are cheaper for each place, and long ones are worth it where
pieces are long or fill them better.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skein.llm import scratch
from skein.llm.text import own_columns

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its places, in places.
OVERHEAD = 64
#: Size at which the squared part of the cost is as large as the linear one.
SQUARE = 16384
SHARD_ROWS = 4096


def cost(size: int, overhead: int = OVERHEAD, square: int = SQUARE) -> float:
    """Cost of one sequence of ``size`` places."""
    return overhead + size + size * size / square


class Lengths:
    """Histogram of the lengths still to be placed."""

    def __init__(self, lengths: Sequence[int]):
        self.count: dict[int, int] = {}
        self.mask = 0
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
            self.mask |= 1 << n

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask &= ~(1 << n)

    def fill(self, room: int) -> int:
        """Tokens that the longest lengths that fit, one after the other, put into ``room``."""
        left, mask = room, self.mask & ~1
        while left > 0 and (fits := mask & ((1 << (left + 1)) - 1)):
            n = fits.bit_length() - 1
            left -= n * min(self.count[n], left // n)
            mask = fits & ~(1 << n)
        return room - left


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, square: int = SQUARE) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (at most the largest capacity), and the capacity of each bin."""
    sizes = sorted(set(capacities))
    price = {s: cost(s, overhead, square) for s in sizes}
    rest = Lengths(lengths)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a bin with room r is open
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    opened: list[int] = []
    used: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        rest.take(n)
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: (price[s] / max(1, n + rest.fill(s - n)), s))
            b, room = len(opened), size
            opened.append(size)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room -= n
        if room:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins, offsets, [next(s for s in sizes if s >= u) for u in used]


def pack_documents(docs: DataFrame, length: object, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS, square: int = SQUARE) -> DataFrame:
    """One row per piece of a document: ``id_col``, piece, n_tokens, bin_id, capacity, offset, bin_used.

    ``length`` is a column expression for a document's tokens.  A document longer than the
    largest capacity is cut into pieces of that size and a rest.  Rows are dealt to shards by id, piece, length and place
    in a written table, so that rows without id and repeated rows are spread as well.

    A null or negative length counts as 0 and takes an empty piece.  Null ids and repeated
    rows are packed like any others.  An empty table gives an empty result.  Other columns are ignored.
    """
    largest = max(capacities)
    sized = docs.select(F.col(f"`{id_col}`").alias("_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("_n"))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / largest) - 1, F.lit(0))), lambda k: F.struct(k.alias("piece"), F.least(F.col("_n") - k * largest, F.lit(largest)).alias("n_tokens")))
    cut = sized.select("_id", F.explode(pieces).alias("p")).select("_id", F.col("p.piece").cast("int").alias("piece"), F.col("p.n_tokens").cast("int").alias("n_tokens"))
    cut = scratch.write(cut, "pack-pieces")
    shards = max(1, -(-cut.count() // shard_rows))
    kind = cut.schema["_id"].dataType.simpleString()

    def run(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, sizes = pack(rows["n_tokens"].tolist(), capacities, overhead, square)
        filled = [0] * len(sizes)
        for b, n in zip(bins, rows["n_tokens"], strict=True):
            filled[b] += n
        return pd.DataFrame(
            {
                "_id": rows["_id"],
                "piece": rows["piece"],
                "n_tokens": rows["n_tokens"],
                "bin_id": [int(shard[0]) << 32 | b for b in bins],
                "capacity": [sizes[b] for b in bins],
                "offset": offsets,
                "bin_used": [filled[b] for b in bins],
            }
        )

    packed = cut.withColumn("_shard", F.pmod(F.xxhash64("_id", "piece", "n_tokens", F.monotonically_increasing_id()), F.lit(shards))).groupBy("_shard").applyInPandas(run, f"_id {kind}, piece int, n_tokens int, bin_id long, capacity int, offset int, bin_used int")
    return packed.withColumnRenamed("_id", id_col)


def word_tokens(text_col: str = "text") -> object:
    """Whitespace-separated words of a text, and one end token."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    return F.when(text == "", F.lit(1)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 2).cast("long")


def pack_sequences(docs: DataFrame, tokens_col: str = "tokens", id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, pad: int = 0, **options: int) -> DataFrame:
    """The packed sequences: bin_id, capacity, n_tokens, tokens (padded to capacity), documents array<struct<id, piece, offset, n_tokens>>.

    ``tokens_col`` is an array of token ids; a document's pieces are packed as :func:`pack_documents`
    does, and their tokens stand at the offsets it gives.  Null and empty arrays have an empty piece.  Null ids and repeated rows are packed
    like any others; an empty table gives an empty result; other columns are ignored.
    """
    largest = max(capacities)
    rows = docs.select(F.col(f"`{id_col}`").alias("_doc"), F.coalesce(F.col(f"`{tokens_col}`"), F.expr("array()").cast(docs.schema[tokens_col].dataType)).alias("_tokens"))
    rows = scratch.write(rows, "pack-tokens").withColumn("_row", F.monotonically_increasing_id())  # places in a written table stay as they are
    rows = scratch.write(rows, "pack-rows")
    packed = pack_documents(rows, F.size("_tokens"), "_row", capacities, **options)
    placed = packed.join(rows, "_row").select("bin_id", "capacity", "offset", F.col("_doc").alias("id"), "piece", "n_tokens", F.slice("_tokens", F.col("piece") * largest + 1, F.col("n_tokens")).alias("part"))
    bins = placed.groupBy("bin_id", "capacity").agg(F.sort_array(F.collect_list(F.struct("offset", "n_tokens", "piece", "id", "part"))).alias("x"))  # a bin holds as many places as its capacity
    tokens = F.flatten(F.transform("x", lambda p: p["part"]))
    padding = F.array_repeat(F.lit(pad).cast(docs.schema[tokens_col].dataType.elementType), (F.col("capacity") - F.size(tokens)).cast("int"))
    named = F.transform("x", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["n_tokens"].alias("n_tokens")))
    return bins.select("bin_id", "capacity", F.size(tokens).alias("n_tokens"), F.concat(tokens, padding).alias("tokens"), named.alias("documents"))
