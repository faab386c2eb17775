"""Table forms of list, map and domain steps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions.lists import gather

#: Rows of one block of :func:`lower_triangle`, and pairs of rows for each of its tasks.
BLOCK, PAIRS = 512, 1 << 22


def collect_ordered(df: DataFrame, by: Sequence[str], order: Sequence[str], **lists: Column) -> DataFrame:
    """One row per group with ordered lists.  One shuffle and one sort; a group's lists are values, so groups must fit a row."""
    item = F.struct(F.struct(*[F.col(c).alias(c) for c in order]).alias("pos"), *[v.alias(k) for k, v in lists.items()])
    groups = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return groups.select(*by, *[F.col(f"_items.{k}").alias(k) for k in lists])


def unfold(df: DataFrame, column: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per element; rows with an empty list give none."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias(pos, value))


def merge_counts(df: DataFrame, key: str, count: str) -> DataFrame:
    """Counts of equal keys, added."""
    return df.groupBy(key).agg(F.sum(count).alias(count))


def add_missing(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """``df`` and the reference rows whose key it lacks."""
    return df.unionByName(reference.join(df.select(key).distinct(), key, "left_anti").select(df.columns))


def lower_triangle(df: DataFrame, index: str, value: str, within: str, score, least: Column | None = None, repeated: bool = False) -> DataFrame:
    """Pairs (i, j), j <= i, inside each group, with their mirror images.

    A group gives as many rows as the square of its size.  Its rows are dealt into blocks of about ``BLOCK``, a pair of
    blocks is a key of the join, and the number of tasks, one for each ``PAIRS`` pairs at least, is taken from a count when the
    plan is made: what a task holds and makes does not grow with the groups.  Rows without group or index give none.

    With ``repeated``, values recur: each two of them that meet in a group are scored once for each order, and rows meet only
    where ``least`` leaves an element; each row is held against blocks of those with one value.
    """
    kind = [F.struct(F.col(value).alias("v")).alias("kind")] if repeated else []  # a struct, so that null is equal to null
    rows = df.select(F.col(within), F.col(index).alias("at"), F.col(value).alias("v"), *kind).filter(F.col(within).isNotNull() & F.col("at").isNotNull())
    pairs = rows.groupBy(within).count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0
    tasks = max(1, math.ceil(pairs / PAIRS))
    by = [within, "kind"] if repeated else [within]
    parts = rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    # rows are spread before each is repeated for all blocks that it meets
    dealt = rows.join(parts, by).withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")).cast("int")).repartition(tasks, "at")
    others = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    lower = F.col("j") <= F.col("i")
    if repeated:
        kinds = (parts.withColumnsRenamed({"kind": f"kind_{x}", "parts": f"parts_{x}"}) for x in "ij")
        met = next(kinds).join(next(kinds), within).drop("parts_i")
        scores = [score(F.col(f"kind_{x}.v"), F.col(f"kind_{y}.v")).alias(name) for x, y, name in (("i", "j", "down"), ("j", "i", "up"))]
        # a generated row is made once; a filter on plain columns would move to where the pairs still repeat
        told = met.select("kind_i", "kind_j").distinct().repartition(tasks, "kind_i", "kind_j").select("*", F.inline(F.array(F.struct(*scores))))
        if least is not None:
            told = told.filter((F.abs("down") > least) | (F.abs("up") > least))
        met = met.join(told, ["kind_i", "kind_j"])
        on = [within, "kind_j", "part_j"]
        one = dealt.select(within, F.col("kind").alias("kind_i"), F.col("at").alias("i")).join(met, [within, "kind_i"]).select(within, "kind_j", others("parts_j").alias("part_j"), "i", "down", "up")
        two = dealt.select(within, F.col("kind").alias("kind_j"), F.col("part").alias("part_j"), F.col("at").alias("j"))
        element = F.when(lower, F.col("down")).otherwise(F.col("up"))
    else:
        on = [within, "part_i", "part_j"]
        one = dealt.select(within, F.col("part").alias("part_i"), others("parts").alias("part_j"), F.col("at").alias("i"), F.col("v").alias("vi"))
        two = dealt.select(within, others("parts").alias("part_i"), F.col("part").alias("part_j"), F.col("at").alias("j"), F.col("v").alias("vj"))
        element = score(F.when(lower, F.col("vi")).otherwise(F.col("vj")), F.when(lower, F.col("vj")).otherwise(F.col("vi")))
    # merged, not broadcast or built in memory: both sides grow with the input
    out = one.repartition(tasks, *on).join(two.repartition(tasks, *on).hint("merge"), on).select(within, "i", "j", element.alias("element"))
    return out if least is None else out.filter(F.abs("element") > least)


def summed_terms(df: DataFrame, term: Sequence[str], weight: str, least: float) -> DataFrame:
    """Weights of equal terms added; sums no larger than ``least`` go."""
    return df.groupBy(*term).agg(F.sum(weight).alias(weight)).filter(F.abs(weight) > least)


def within_budget(df: DataFrame, by: str, weight: str, cost: str, budget: float, tie: Sequence[str]) -> DataFrame:
    """In each group the heaviest rows whose running cost stays within the budget; ties go by ``tie``."""
    w = Window.partitionBy(by).orderBy(F.abs(weight).desc(), *tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def expand_configurations(df: DataFrame, column: str, reference: str) -> DataFrame:
    """Configurations with the spins of singly filled places dealt out in every way, once each.

    Bit strings hold two spins for each place, in turn.  Kept are those with as many ones of either spin
    as ``reference``; beginnings that already have too many are not followed.
    """
    up, down = reference[0::2].count("1"), reference[1::2].count("1")

    def ones(bits: Column, spin: int) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), F.length(bits) - 1), lambda i: (i % 2 == spin) & (F.substring(bits, i + 1, F.lit(1)) == "1")))

    def step(begun: Column, i: Column) -> Column:
        pair = F.substring(column, 2 * i + 1, F.lit(2))
        both = F.concat(F.transform(begun, lambda x: F.concat(x, F.lit("10"))), F.transform(begun, lambda x: F.concat(x, F.lit("01"))))
        grown = F.when(pair.isin("10", "01"), both).otherwise(F.transform(begun, lambda x: F.concat(x, pair)))
        return F.filter(grown, lambda x: (ones(x, 0) <= up) & (ones(x, 1) <= down))

    places = F.sequence(F.lit(0), (F.length(column) / 2).cast("int") - 1)
    dealt = F.aggregate(places, F.array(F.lit("")), step)
    return df.filter(F.length(column) >= 2).select(column).distinct().select(F.explode(F.filter(dealt, lambda x: (ones(x, 0) == up) & (ones(x, 1) == down))).alias(column)).distinct()


def matrix_element(left: Column, right: Column, one_body: Column, two_body: Column, places: int, constant: float) -> Column:
    """Element between two determinants, by the rule for none, one or two places that differ; 0 for more, or for unequal numbers of ones.

    ``left`` and ``right`` are array<int> of 0 and 1, two spins for each place in turn; the integrals are
    flat arrays over ``places``, of rank two and four.
    """
    half = lambda x: F.shiftright(x, 1)
    like = lambda x, y: x % 2 == y % 2
    every = F.sequence(F.lit(0), F.lit(2 * places - 1))

    def one(p: Column, q: Column) -> Column:
        return F.when(like(p, q), F.get(one_body, half(p) * places + half(q))).otherwise(0.0)

    def two(p: Column, q: Column, r: Column, t: Column) -> Column:
        return F.when(like(p, q) & like(r, t), F.get(two_body, ((half(p) * places + half(q)) * places + half(r)) * places + half(t))).otherwise(0.0)

    def total(items: Column, of) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda acc, i: acc + of(i))

    def after(bits: Column, i: Column) -> Column:
        return F.aggregate(F.slice(bits, i + 2, F.lit(2 * places)), F.lit(0), lambda acc, x: acc + x)

    gone = F.filter(every, lambda i: F.get(right, i) < F.get(left, i))
    come = F.filter(every, lambda i: F.get(right, i) > F.get(left, i))
    filled = F.filter(every, lambda i: F.get(left, i) == 1)
    turns = F.aggregate(gone, F.lit(0), lambda acc, i: acc + after(left, i)) + F.aggregate(come, F.lit(0), lambda acc, i: acc + after(right, i))
    phase = F.when(turns % 2 == 0, 1.0).otherwise(-1.0)
    g0, g1, c0, c1 = (F.get(x, F.lit(i)) for x in (gone, come) for i in (0, 1))
    double = two(g0, c0, g1, c1) - two(g0, c1, g1, c0)
    single = one(g0, c0) + total(F.filter(filled, lambda i: i != g0), lambda i: two(g0, c0, i, i) - two(g0, i, i, c0))
    same = total(filled, lambda i: one(i, i) + total(F.filter(filled, lambda j: j < i), lambda j: two(i, i, j, j) - two(i, j, j, i))) + constant
    moved = F.size(gone)
    return F.when((F.size(come) != moved) | (moved > 2), 0.0).when(moved == 2, double * phase).when(moved == 1, single * phase).otherwise(same)


def shots_to_dict(df: DataFrame, by: Sequence[str], register: str, shot: str, bit: str, value: str) -> DataFrame:
    """Bits by register and shot as a map from register to the list of its shots' bit strings."""
    strings = df.groupBy(*by, register, shot).agg(F.array_join(gather(F.collect_list(F.struct(F.col(bit).alias("pos"), F.col(value).cast("string").alias("v")))), "").alias("bits"))
    lists = strings.groupBy(*by, register).agg(gather(F.collect_list(F.struct(F.col(shot).alias("pos"), F.col("bits").alias("v")))).alias("shots"))
    return lists.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(register, "shots")))).alias("registers"))


def dict_to_shots(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """A map from register to bit strings as one row per register, shot and bit."""
    shots = df.select(*by, F.explode(column).alias("register", "shots")).select(*by, "register", F.posexplode("shots").alias("shot", "bits"))
    return shots.select(*by, "register", "shot", F.posexplode(F.filter(F.split("bits", ""), lambda b: b != "")).alias("bit", "value")).withColumn("value", F.col("value").cast("int"))


def expectation(df: DataFrame, by: Sequence[str], bits: str, count: str) -> DataFrame:
    """Mean parity sign of counted bit strings."""
    ones = F.length(F.replace(F.col(bits), F.lit("0"), F.lit("")))
    sign = F.when(ones % 2 == 0, 1).otherwise(-1)
    return df.groupBy(*by).agg((F.sum(sign * F.col(count)) / F.sum(count)).alias("expectation"))


def linspace(start: Column, stop: Column, num: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda i: start + i * (stop - start) / max(1, num - 1))


def transpose(shape: Column, data: Column) -> Column:
    """Flat data of a matrix with rows and columns swapped."""
    rows, cols = F.get(shape, F.lit(0)), F.get(shape, F.lit(1))
    return F.transform(F.sequence(F.lit(0), rows * cols - 1), lambda k: F.get(data, (k % rows) * cols + F.floor(k / rows).cast("int")))


def reshape(shape: Column, data: Column, new: Sequence[int]) -> Column:
    """The same flat data under another shape of equal size; sizes that differ raise."""
    size = F.aggregate(shape, F.lit(1), lambda a, x: a * x)
    wanted = 1
    for n in new:
        wanted *= n
    return F.when((size == wanted) | F.raise_error(F.lit(f"cannot reshape to {list(new)}")).cast("boolean"), F.struct(F.array(*[F.lit(n) for n in new]).alias("shape"), data.alias("data")))


def pointed(data: Column, at: Column) -> Column:
    """An array with a place in it; :func:`at_point` reads what stands there."""
    return F.struct(data.alias("data"), at.alias("at"))


def at_point(p: Column) -> Column:
    return F.element_at(p["data"], p["at"].cast("int") + 1)


def split_space(df: DataFrame, by: Sequence[str], order: str, occupation: str, active: int, electrons: int) -> DataFrame:
    """Adds ``space``: core, active or virtual, by place in each group.

    Half of the occupation that ``electrons`` active ones leave over fills the core; ``active`` places
    follow.  A group that is too small for both raises.
    """
    whole = Window.partitionBy(*by)
    core = F.floor((F.sum(occupation).over(whole) - electrons) / 2)
    place = F.row_number().over(whole.orderBy(order)) - 1
    fits = (core + active <= F.count("*").over(whole)) | F.raise_error(F.lit("active space is larger than the group")).cast("boolean")
    return df.withColumn("space", F.when(fits, F.when(place < core, "core").when(place < core + active, "active").otherwise("virtual")))


def configurations(spark, electrons: int, places: int, multiplicity: int = 1, core: int = 0, virtual: int = 0) -> DataFrame:
    """Bit strings of two spins in turn, each spin with (electrons - multiplicity + 1) // 2 ones in every way; ``core`` full places before, ``virtual`` empty ones behind.

    A row for each string of one spin is spread over the cluster and gives the rows of the other.
    """
    ones = (electrons - multiplicity + 1) // 2
    spin = spark.range(1 << places).filter(F.bit_count("id") == ones).select(F.col("id").alias("a"))
    both = spin.select("a", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << places) - 1)), lambda x: F.bit_count(x) == ones)).alias("b"))
    bit = lambda x, i: F.get(F.split(F.lpad(F.bin(x), places, "0"), ""), i)
    inner = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.concat(bit("a", i), bit("b", i))), "")
    return both.select(F.concat(F.lit("11" * core), inner, F.lit("00" * virtual)).alias("bits"))


def greedy(pool: DataFrame, key: str, score: str, cost: str, budget: float, step: int = 1000) -> list[tuple]:
    """Takes the row with the highest score per cost that still fits, again and again, to the end: (key, left after it).

    What no longer fits never will, so rows are looked at once, in order of score per cost, then of key.  Only the
    next ``step`` rows that fit come to the driver at a time.
    """
    left, taken, last = budget, [], None
    rows = pool.select(F.col(key).alias("k"), F.col(cost).alias("c"), (F.col(score) / F.col(cost)).alias("r")).filter("k is not null and r is not null")
    while True:
        fits = rows.filter(F.col("c") <= F.lit(left))
        if last is not None:
            fits = fits.filter((F.col("r") < F.lit(last[0])) | ((F.col("r") == F.lit(last[0])) & (F.col("k") > F.lit(last[1]))))
        ahead = fits.orderBy(F.col("r").desc(), "k").limit(step).collect()
        for x in ahead:
            if x["c"] <= left:
                left -= x["c"]
                taken.append((x["k"], left))
        if len(ahead) < step:
            return taken
        last = (ahead[-1]["r"], ahead[-1]["k"])
