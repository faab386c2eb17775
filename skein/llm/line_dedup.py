"""Near-duplicate lines by an exact set-similarity join, with DataFrame operations only.

A line's set holds its distinct words: what blanks (space, tab, CR, form feed, vertical tab)
separate, in lower case.  Lines with one set are one class.  Texts are split and hashed once; all else reads the hashes.
Words are ordered by rarity, by way of a table of ``BUCKETS`` counters over the words of all lines, whose size does not depend on the data.  Two sets as similar as asked share a word among their
few rarest ones (prefix filter); sizes and the places of the rarest one that they share bound the overlap (length
and positional filter), as do 128-bit bitmaps of the sets; the words before it are not the same in both.

No step makes a row for each pair.  Semi-joins leave the (word, class) rows at which some other class
may be similar, first by these filters, then by wider bitmaps and only where the word is the rarest that both share.
What is left meets by word in blocks of bounded size: a class is held against a whole block by bitmaps and then by whole sets
inside the row, and the row gives a count.  Each pair meets at one word, so that counts add up.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from skein.llm import prune, scratch
from skein.llm.text import free_name, own_columns

#: Least Jaccard similarity, per cent, where a call names none.
THRESHOLD = 85
BUCKETS = 65536
#: Members of one block of the last step.
BLOCK = 256
#: Shares of the words that the index is shuffled in, one after the other.
SHARES = 4
_LEVEL_BITS = 7
#: A dictionary of words would take half the room and twice the time.
_PLAIN = {"parquet.enable.dictionary": "false"}


def _plain(text: Column) -> Column:
    """Lower case, with spaces for all other blanks inside lines; a text without them is only searched."""
    text = F.lower(text)
    for blank in "\t\r\f\v":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1))


def _hashes(line: Column) -> Column:
    """Distinct words as hashes, in ascending order."""
    return F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w))))


def _codes(hashes: Column, ranks: Column) -> Column:
    """Words as numbers that sort rarest first: the level of a word's counter above the other bits of its hash."""

    def code(h: Column) -> Column:
        # every bucket has a level; elements that cannot be null are sorted as plain longs
        level = F.coalesce(F.get(ranks, _bucket(h).cast("int")), F.lit(0).cast("tinyint")).cast("long")
        return F.shiftleft(level, 63 - _LEVEL_BITS) + F.shiftrightunsigned(h, 1 + _LEVEL_BITS)

    return F.transform(hashes, code)


def _levels(seen: dict[int, int]) -> Column:
    """A level for each counter by the share of all words that the smaller counters hold; short, as plans carry it."""
    total, below, level = max(1, sum(seen.values())), 0, [0] * BUCKETS
    for b in sorted(range(BUCKETS), key=lambda b: (seen.get(b, 0), b)):
        level[b] = (below << _LEVEL_BITS) // total
        below += seen.get(b, 0)
    return F.split(F.lit(",".join(map(str, level))), ",").cast("array<tinyint>")


def _bits(s: Column) -> Column:
    """One bit for each of 64 shares of the words, set where the set has any of them."""
    return F.aggregate(s, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))


def _in_ranges(classes: DataFrame, ranks: Column, parts: int) -> DataFrame:
    """``s`` as codes, rarest first, cut into r0, r1, ... by ranges of levels.

    Marks sorted in between the words part the ranges, so that no word is looked at again for each of them.
    """
    marks = [F.lit(q * 2**63 // parts) for q in range(1, parts)]
    others = [c for c in classes.columns if c != "s"]
    out = classes.select(*others, F.sort_array(F.concat(_codes(F.col("s"), ranks), F.array(*marks))).alias("s"))
    ends = [F.lit(0), *[F.array_position("s", mark).cast("int") for mark in marks], F.size("s") + 1]
    out = out.select(*others, "s", *[z.alias(f"z{q}") for q, z in enumerate(ends)])
    return out.select(*others, *[F.slice("s", F.col(f"z{q}") + 1, F.col(f"z{q + 1}") - F.col(f"z{q}") - 1).alias(f"r{q}") for q in range(parts)])


def _most(parts: int) -> Column:
    """Words that classes a and b can share at most: a bit that only one has stands for a word that the other lacks."""

    def lacking(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"{x}.m{q}").bitwiseAND(F.bitwise_not(F.col(f"{y}.m{q}")))) for q in range(parts)), F.lit(0))

    return F.least(F.col("a.n") - lacking("a", "b"), F.col("b.n") - lacking("b", "a"))


def _sizes(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _need(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of sets of these sizes, times (100 + percent)."""
    return (n + m) * percent


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """One row per id and text: ``id_col``, row_key, n_lines, n_removed, n_links, removed (numbers of removed lines, ascending from 0).

    Lines are ordered by id and number.  A line is removed when an earlier one has a
    Jaccard similarity of ``percent`` per cent or more with it, be that one removed or not.  n_links counts, over the
    document's lines, the other classes that each is similar to.  Lines without words are
    never removed and link nothing.

    Null text counts as empty, one line without words.  Rows with one id and different texts are documents of
    their own, told apart by ``row_key``, a hash of the text, which also orders them.  Rows that repeat id and text are one document,
    whose lines with one number come at the same place and do not remove each other.  Null ids come first.
    An empty table gives an empty result.  Other columns are ignored.  Classes are told apart by 64-bit hashes of their sets.
    """
    base = own_columns(docs, id_col, text_col).toDF("_id", "_text").select("_id", F.xxhash64("_text").alias("_h"), _plain(F.coalesce("_text", F.lit(""))).alias("_text"))
    lines = base.select("_id", "_h", F.posexplode(F.split("_text", "\n")).alias("_no", "_line"))
    n = F.col("n")
    prefix = (n - F.ceil(n * percent / 100) + 1).cast("int")
    able = n * 100 >= (n + 1) * percent  # else only an equal set is similar enough
    at = F.struct("_id", "_h", "_no")
    full = lines.select("_id", "_h", "_no", _hashes(F.col("_line")).alias("s")).select("_id", "_h", "_no", F.size("s").alias("n"), F.when(F.size("s") > 0, F.xxhash64("s")).alias("c"), "s")
    full = scratch.write(full, "lines", **_PLAIN)
    places = full.select("_id", "_h", "_no", "c")
    counts = full.select(F.explode("s").alias("w")).groupBy(_bucket(F.col("w")).alias("b")).count()
    ranks = _levels({r["b"]: r["count"] for r in counts.collect()})  # BUCKETS rows at most
    many = scratch.write(places.filter("c is not null").groupBy("c").count().filter("count > 1").select("c"), "line-copied")
    copied = prune.tester(many)(F.col("c"))
    firsts = places.filter(copied).groupBy("c").agg(F.min(at).alias("at"), F.count("*").alias("copies")).filter("copies > 1").select("c", "at")

    # classes that some other class may be similar to, at each word of their prefix where one is met
    cols = ["c", "n", "p", "m0", "m1"]
    fit = _in_ranges(full.filter(able & (n > 0)).select("c", "n", "s"), ranks, 2)
    p = F.when(F.size("r0") < prefix, F.slice(F.concat("r0", "r1"), F.lit(1), prefix)).otherwise(F.slice("r0", F.lit(1), prefix))
    fit = fit.select("c", "n", p.alias("p"), _bits(F.col("r0")).alias("m0"), _bits(F.col("r1")).alias("m1"))
    once = fit.filter(copied).groupBy("c").agg(F.min(F.struct(*cols[1:])).alias("x")).select("c", "x.*")
    fit = scratch.write(fit.filter(~copied).unionByName(once), "line-prefixes", **_PLAIN)
    # the rarest word that two classes share is where they meet: none comes before it in both, so what they share stands from there on
    # (``reach``: the largest class that can be similar then), and the word before it is not the same
    index = fit.select("c", "n", "m0", "m1", "p", F.posexplode("p").alias("i", "w"))
    reach = F.floor(((n - F.col("i")) * (100 + percent) - n * percent) / percent).cast("int")
    before = F.when(F.col("i") > 0, F.get("p", F.col("i") - 1)).otherwise(F.lit(-1).cast("long"))
    index = index.select("c", "n", "m0", "m1", "w", reach.alias("reach"), F.coalesce(before, F.lit(-1).cast("long")).alias("before"))
    near = (
        (F.col("a.w") == F.col("b.w"))
        & (F.col("a.n") <= F.col("b.reach"))
        & (F.col("b.n") <= F.col("a.reach"))
        & (F.col("a.c") != F.col("b.c"))
        & ((F.col("a.before") != F.col("b.before")) | (F.col("a.before") < 0))
        & (_most(2) * (100 + percent) >= _need(F.col("a.n"), F.col("b.n"), percent))
    )
    first = []
    for share in range(SHARES):
        # both sides are the same plan, names included, so that one exchange serves them; it goes before the next share comes
        words = index.filter(F.pmod("w", F.lit(SHARES)) == share)
        first.append(scratch.write(words.alias("a").join(words.alias("b"), near, "left_semi").select("w", "c"), "line-met"))
    scratch.drop(fit)
    met = functools.reduce(DataFrame.unionByName, first)

    # whole sets of those classes, from the places where they first stand
    named = scratch.write(met.select("c").distinct(), "line-named")
    held = prune.may_join(full.select("c", at.alias("here"), "n", "s"), "c", named).groupBy("c").agg(F.min(F.struct("here", "n", "s")).alias("x"))
    sets = held.join(named, "c", "left_semi").select("c", F.col("x.here").alias("at"), "x.n", "x.s")
    ranges = [f"r{q}" for q in range(4)]
    stored = scratch.write(_in_ranges(sets, ranks, 4).select("*", *[_bits(F.col(r)).alias(f"m{q}") for q, r in enumerate(ranges)]), "line-sets", **_PLAIN)
    firsts = scratch.write(firsts, "line-firsts")
    places = scratch.write(places, "line-places")
    scratch.drop(full, many)

    # 256 parts tell more than 128; of the words that two classes share, only the rarest is where they meet
    wide = ["n", *[f"m{q}" for q in range(4)]]
    sets = stored.select("c", "at", *wide, *ranges, F.slice(F.concat(*ranges), F.lit(1), prefix).alias("p"))
    rarer = F.slice("p", F.lit(1), F.array_position("p", F.col("w")).cast("int") - 1).alias("q")
    shown = met.join(sets.select("c", *wide, "p"), "c").select("w", "c", *wide, rarer)
    near = (
        (F.col("a.w") == F.col("b.w"))
        & (F.col("a.c") != F.col("b.c"))
        & _sizes(F.col("a.n"), F.col("b.n"), percent)
        & (_most(4) * (100 + percent) >= _need(F.col("a.n"), F.col("b.n"), percent))
        & ~F.arrays_overlap("a.q", "b.q")
    )
    met = scratch.write(shown.alias("a").join(shown.alias("b"), near, "left_semi").select("w", "c"), "line-likely")
    scratch.drop(*first)

    # each class against the blocks of those that meet it at a word; links are counted, not made
    parts = met.groupBy("w").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    member = met.join(parts, "w").join(sets, "c")
    member = scratch.write(member.select("w", "parts", "c", "at", *wide, rarer, *ranges), "line-members", **_PLAIN)
    own = ["c", "at", *wide, "q", *ranges]
    blocks = member.groupBy("w", F.pmod(F.xxhash64("c"), "parts").cast("int").alias("part")).agg(F.collect_list(F.struct(*own)).alias("block"))
    asked = member.select("w", *own, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def similar(y: Column) -> Column:
        # words that only one of the two has are at least as many as the bits that only one has
        apart = sum((F.bit_count(F.col(f"m{q}").bitwiseXOR(y[f"m{q}"])) for q in range(4)), F.lit(0))
        both = F.col("n") + y["n"]
        likely = _sizes(F.col("n"), y["n"], percent) & (apart * (100 + percent) <= both * (100 - percent)) & ~F.arrays_overlap(F.col("q"), y["q"])
        shared = sum((F.when(F.col(r) == y[r], F.size(r)).otherwise(F.size(F.array_intersect(F.col(r), y[r]))) for r in ranges), F.lit(0))
        return (y["c"] != F.col("c")) & likely & (shared * (100 + percent) >= both * percent)

    told = asked.join(blocks, ["w", "part"]).select("c", F.transform(F.filter("block", similar), lambda y: y["at"] < F.col("at")).alias("before"))
    told = told.select("c", F.size("before").alias("links"), F.array_contains("before", True).alias("late"))
    linked = scratch.write(told.groupBy("c").agg(F.max("late").alias("late"), F.sum("links").alias("links")).filter("links > 0"), "line-links")

    told = scratch.write(firsts.join(linked, "c", "full_outer"), "line-told")
    scratch.drop(firsts, named, stored, met, member, linked)

    # lines that are neither copied nor linked only count
    gone = F.coalesce(F.col("late"), F.lit(False)) | F.coalesce(at != F.col("at"), F.lit(False))
    judged = prune.may_join(places, "c", told.select("c")).join(told, "c").select("_id", "_h", F.lit(0).cast("long").alias("lines"), "_no", gone.alias("gone"), F.coalesce("links", F.lit(0)).alias("links"))
    counted = places.groupBy("_id", "_h").agg(F.count("*").alias("lines")).select("*", F.lit(0).alias("_no"), F.lit(False).alias("gone"), F.lit(0).cast("long").alias("links"))
    judged = judged.unionByName(counted)
    out = judged.groupBy("_id", "_h").agg(
        F.sum("lines").alias("n_lines"),
        F.sum(F.col("gone").cast("long")).alias("n_removed"),
        F.sum("links").cast("long").alias("n_links"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("gone"), F.col("_no"))))).alias("removed"),
    )
    return out.withColumnsRenamed({"_id": id_col, "_h": "row_key"})


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """``docs`` with the lines cut from ``text_col`` that :func:`repeated_lines` removes; other columns and null texts stay.

    A row for each input row: rows with one id and different texts are cut each for itself, repeated rows
    alike, null ids like others.  An empty table gives an empty result.  Columns of any name may stand beside these.
    """
    cut, key, gone = (free_name(docs, x) for x in ("cut", "key", "gone"))
    found = repeated_lines(docs, id_col, text_col, percent).filter("n_removed > 0").select(F.col(id_col).alias(cut), F.col("row_key").alias(key), F.col("removed").alias(gone))
    found = scratch.write(found, "line-removals")
    text = docs[f"`{text_col}`"]
    joined = docs.join(found, docs[f"`{id_col}`"].eqNullSafe(F.col(cut)) & (F.xxhash64(text) == F.col(key)), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return joined.withColumn(text_col, F.when(F.col(gone).isNull() | text.isNull(), text).otherwise(kept)).select(*[f"`{c}`" for c in docs.columns])
