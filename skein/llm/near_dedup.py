"""Near-duplicate documents by HyperMinHash registers.

Each distinct five-word shingle is hashed once.  The top bits of the hash choose a register,
which keeps the least of the other bits as a leading-zero count and a few mantissa bits.
Small sets leave registers empty; these borrow from filled ones by a fixed random rule, so
that two registers agree with the sets' Jaccard similarity at every size.  Bands of four
registers propose candidates, a collision-corrected estimate thins them, and the whole
shingle sets decide.

Copies are folded first: texts with one shingle set are one class, and only one of a class
goes on.  In a bucket the members are not paired with each other.  First each is held
against the bucket's smallest id, and the confirmed links are closed to components.  Components
that the estimate still finds alike in some bucket form a family; the members of a family
are held against each other on their whole sets in blocks of bounded size, which give back only the links
that join components.  So a large group of near copies costs about one link per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm import kernels as K
from skein.llm import prune, scratch
from skein.llm.components import components
from skein.llm.settle import settle
from skein.llm.text import own_columns

IS_WORD = K.word_set([(0x20, 0x20), (0x09, 0x0D)])
SHINGLE = 5
REGISTERS, BUCKET_BITS = 128, 7
BANDS, ROWS = 32, 4
MANTISSA = 10
THRESHOLD = 75  # per cent
#: Five standard deviations of an estimate of 0.75 from 128 registers.
MARGIN = 0.2
#: Members of a bucket, and of a family, that one block takes from either side.
BUCKET_CHUNK = 512
FAMILY_CHUNK = 128

_VALUE_BITS = 64 - BUCKET_BITS
_BORROW = np.argsort(K.mix(np.arange(1, 64 * REGISTERS + 1, dtype=np.uint64)).reshape(64, REGISTERS) % np.uint64(1 << 31), axis=1)
EMPTY = np.uint16(0xFFFF)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets, IS_WORD)
    codes = K.slice_hashes(K.prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    weights = K.powers(K.BASE, SHINGLE + 1)
    full = max(0, len(codes) - SHINGLE + 1)
    rolled = np.zeros(full, np.uint64)
    for j in range(SHINGLE):
        rolled += codes[j : j + full] * weights[j]
    rolled = K.mix(rolled + np.uint64(SHINGLE))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            h = np.sort(rolled[a : b - SHINGLE + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) > 1 else h)
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(K.mix(np.array([(codes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(codes[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; empty ones filled from others where the set has any element."""
    sizes = np.array([len(s) for s in sets])
    sig = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    if sizes.sum() == 0:
        return sig
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = (h >> np.uint64(_VALUE_BITS)).astype(np.int64)
    slot = row * REGISTERS + bucket
    least = np.concatenate(([True], slot[1:] != slot[:-1]))  # sets are sorted, so the first of a bucket is its least
    v = h[least] & np.uint64((1 << _VALUE_BITS) - 1)
    bits = np.frexp(v.astype(np.float64))[1]
    bits = np.where((bits > 0) & ((v >> np.maximum(bits - 1, 0).astype(np.uint64)) == 0), bits - 1, bits)
    below = v & ((np.uint64(1) << np.maximum(bits - 1, 0).astype(np.uint64)) - np.uint64(1))
    drop = (bits - 1 - MANTISSA).astype(np.int64)
    mantissa = np.where(drop >= 0, below >> np.maximum(drop, 0).astype(np.uint64), below << np.maximum(-drop, 0).clip(0, MANTISSA).astype(np.uint64))
    code = ((_VALUE_BITS - bits).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    sig.reshape(-1)[slot[least]] = code.astype(np.uint16)
    own = sig != EMPTY
    need = np.flatnonzero((sizes > 0) & ~own.all(axis=1))
    if len(need):
        src, have = sig[need], own[need]
        got, done = src.copy(), have.copy()
        for turn in _BORROW:
            take = ~done & have[:, turn]
            got = np.where(take, src[:, turn], got)
            done |= take
            if done.all():
                break
        for r in np.flatnonzero(~done.all(axis=1)):  # sets of one or two elements, now and then
            filled = np.flatnonzero(have[r])
            lost = np.flatnonzero(~done[r])
            got[r, lost] = src[r, filled[np.searchsorted(filled, lost) % len(filled)]]
        sig[need] = got
    return sig


def _zero_counts(n: np.ndarray) -> np.ndarray:
    """Chances of each leading-zero count of a register of a set of this size."""
    load = np.maximum(n, 1).astype(float)[:, None] / REGISTERS
    edge = np.exp(-load * 2.0 ** -np.arange(0, _VALUE_BITS + 1)[None, :])
    p = edge[:, 1:] - edge[:, :-1]
    return p / p.sum(1, keepdims=True)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of rows of registers.

    Unrelated registers of sets of sizes n and m agree where both leading-zero counts and mantissas do.
    """
    c = (_zero_counts(n) * _zero_counts(m)).sum(1) / (1 << MANTISSA)
    return ((a == b).mean(axis=1) - c) / (1 - c)


LEAST = THRESHOLD / 100 - MARGIN


def _plausible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (100 * np.minimum(n, m) >= THRESHOLD * np.maximum(n, m)) & (estimate(a, b, n, m) >= LEAST)


def _sig(column: pa.Array) -> np.ndarray:
    data, _ = K.flat(column)
    return data.view(np.uint16).reshape(-1, REGISTERS) if len(data) else np.zeros((0, REGISTERS), np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        for lo, hi, part, at in K.blocks(data, offsets):
            sets = shingle_hashes(part, at)
            sig = registers(sets)
            k1 = np.array([K.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            k2 = np.array([K.mix(s ^ np.uint64(K.BASE)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            n = pa.array([len(s) for s in sets], pa.int64())
            sigs = pa.array([x.tobytes() for x in sig], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n, pa.array(k1), pa.array(k2), sigs, batch.column(2).slice(lo, hi - lo)], ["_id", "n", "k1", "k2", "sig", "row_key"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            keep = _plausible(_sig(part.column(2)), _sig(part.column(3)), part.column(4).to_numpy(), part.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows of one group each; rows arrive sorted by group."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        cols = [t.column(c).to_numpy() for c in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *cut.tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield t.slice(a, b - a)
        rest = t.slice(edges[-1])
    if rest is not None and len(rest):
        yield rest


class _Union:
    """Joins labels; tells which links joined two that were apart."""

    def __init__(self) -> None:
        self.top: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (t := self.top.get(x, x)) != x:
            self.top[x] = x = self.top.get(t, t)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.top[max(a, b)] = min(a, b)
        return a != b


def _pairs_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _alike_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components that some pair of a bucket makes likely to be linked; of several such pairs only those that join something new."""
    for t in _groups(batches, ("key", "i", "j")):
        comp, n, own, i, j = (t.column(c).to_numpy() for c in ("comp", "n", "own", "i", "j"))
        sig = _sig(t.column("sig").combine_chunks())
        left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        # one correction for each pair of sizes that occurs, few in a bucket
        sizes, size = np.unique(n, return_inverse=True)
        zeros = _zero_counts(sizes)
        chance = zeros @ zeros.T / (1 << MANTISSA)
        known, links = _Union(), []
        for x in left.tolist():
            lo, hi = np.minimum(n[x], n[right]), np.maximum(n[x], n[right])
            y = right[(comp[right] != comp[x]) & (100 * lo >= THRESHOLD * hi)]
            if not len(y):
                continue
            c = chance[size[x], size[y]]
            good = y[((sig[y] == sig[x]).mean(axis=1) - c) / (1 - c) >= LEAST]
            for q in comp[good].tolist():
                if known.join(int(comp[x]), q):
                    links.append((int(comp[x]), q))
        if links:
            yield _pairs_of(links)


def _family_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links between members of different components, on whole sets; those that join something new."""
    for t in _groups(batches, ("family", "i", "j")):
        rep, comp, minor = t.column("rep").to_pylist(), t.column("comp").to_numpy(), t.column("minor").to_numpy()
        sets: list[np.ndarray] = []
        for _, _, part, at in K.blocks(*K.flat(t.column("_text"))):
            sets += shingle_hashes(part, at)
        size = np.array([len(x) for x in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        known, links = _Union(), []
        for x in np.flatnonzero(minor).tolist():
            has = np.zeros(int(code.max()) + 1, np.int64)
            has[code[ends[x] - size[x] : ends[x]]] = 1
            common = np.add.reduceat(has[code], ends - size)
            good = (100 * common >= THRESHOLD * (size + size[x] - common)) & (comp != comp[x]) & ~minor
            for y in np.flatnonzero(good).tolist():
                if known.join(int(comp[x]), int(comp[y])):
                    links.append((rep[x], rep[y]))
        if links:
            yield _pairs_of(links)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        a_bytes, a_off = K.flat(batch.column(2))
        b_bytes, b_off = K.flat(batch.column(3))
        known: dict[int, np.ndarray] = {}
        ids = batch.column(0).to_pylist()
        for r, a in enumerate(ids):
            if a not in known:
                known = {a: shingle_hashes(a_bytes[a_off[r] : a_off[r + 1]], np.array([0, a_off[r + 1] - a_off[r]]))[0]}
            x = known[a]
            y = shingle_hashes(b_bytes[b_off[r] : b_off[r + 1]], np.array([0, b_off[r + 1] - b_off[r]]))[0]
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep[r] = 100 * common >= THRESHOLD * (len(x) + len(y) - common) and common > 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose whole shingle sets are similar enough.  Only texts that a pair names are kept at hand."""
    need = scratch.write(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "near-needed")
    held = scratch.write(prune.may_join(texts, "_id", need).join(need, "_id", "left_semi"), "near-texts")
    with_b = pairs.join(held.select(F.col("_id").alias("b"), F.col("_text").alias("tb")), "b")
    both = with_b.join(held.select(F.col("_id").alias("a"), F.col("_text").alias("ta")), "a").select("a", "b", "ta", "tb")
    links = scratch.write(both.mapInArrow(_confirmed, "a long, b long"), "near-links")
    scratch.drop(need, held)
    return links


def _between(reps: DataFrame, comp: DataFrame, family: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components of each family, found on whole sets.

    Members of a family's largest component need not be held against each other.  All others
    (minor members) meet every member, in blocks of bounded size: a block has one chunk of
    minor members and one chunk of all.
    """
    family = family.select(F.col("node").alias("comp"), F.col("comp").alias("family"))
    placed = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    placed = scratch.write(placed.join(family, "comp"), "near-family")
    parts = placed.groupBy("family", "comp").agg(F.count("*").alias("n"))
    stats = parts.groupBy("family").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"))
    stats = scratch.write(stats.select("family", "all", (F.col("all") - F.col("top.n")).alias("few"), F.col("top.comp").alias("major")), "near-family-sizes")
    need = scratch.write(placed.select(F.col("rep").alias("_id")), "near-family-ids")
    held = scratch.write(prune.may_join(texts, "_id", need).join(need, "_id", "left_semi").dropDuplicates(["_id"]).withColumnRenamed("_id", "rep"), "near-family-texts")

    def chunk(of: str, salt: int):
        return F.pmod(F.xxhash64("rep", F.lit(salt)), F.ceil(F.col(of) / FAMILY_CHUNK)).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.ceil(F.col(of) / FAMILY_CHUNK).cast("int") - 1))

    rows = placed.join(stats, "family")
    right = rows.select("family", "rep", "comp", chunk("all", 1).alias("j"), every("few").alias("i"), F.lit(False).alias("minor"))
    left = rows.filter("comp <> major").select("family", "rep", "comp", chunk("few", 2).alias("i"), every("all").alias("j"), F.lit(True).alias("minor"))
    both = scratch.write(right.unionByName(left), "near-family-blocks").join(held, "rep")
    dealt = both.repartition(F.col("family"), F.col("i"), F.col("j")).sortWithinPartitions("family", "i", "j")
    links = scratch.write(dealt.mapInArrow(_family_links, "a long, b long"), "near-family-links")
    scratch.drop(placed, stats, need, held)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_key: bool = False) -> DataFrame:
    """One row per input row: ``id_col`` (long), n_shingles, component_id, kept.

    Words are separated by ASCII white space after lower-casing A-Z; a document's set holds
    its distinct five-word shingles, or its whole word sequence if shorter.  Documents with
    Jaccard similarity of 0.75 or more are linked; component_id is the smallest id reachable,
    and kept marks the document that has it.  With ``row_key`` a hash of each row's text is returned too.

    Null texts and texts without words have empty sets and are linked with nothing.  Rows with
    a null id have component_id null and are kept; they link nothing.  Repeated rows are in one
    component and marked alike.  An empty table gives an empty result.  Other columns are ignored.
    A pair of exactly 0.75 is missed by all bands with a chance of 5 in a million, more similar ones far less.
    """
    base = own_columns(docs, id_col, text_col).toDF("_id", "_text").select(F.col("_id").cast("long").alias("_id"), "_text")
    sigs = scratch.write(base.withColumn("row_key", F.xxhash64("_text")).mapInArrow(_sign, "_id long, n long, k1 long, k2 long, sig binary, row_key long"), "near-registers")
    reps = scratch.write(
        sigs.filter("n > 0 and _id is not null").groupBy("k1", "k2", "n").agg(F.min("_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("copies")),
        "near-classes",
    )
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)).alias("key")) for i in range(BANDS)])
    slots = reps.select("rep", F.explode(bands).alias("s")).select("rep", "s.band", "s.key")
    buckets = scratch.write(slots.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).filter("members > 1"), "near-buckets")
    members = scratch.write(slots.join(buckets, "key"), "near-members")

    light = reps.select("rep", "n", "sig")
    star = scratch.write(members.filter("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "near-star")
    signed = star.join(light.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    signed = signed.join(light.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").select("a", "b", "sa", "sb", "na", "nb")
    likely = scratch.write(signed.mapInArrow(_estimated, "a long, b long"), "near-likely")
    texts = base.filter("_id is not null")
    links = _verify(likely, texts)
    comp = components(links)

    # what the stars leave open: buckets of three or more whose members are in several components
    part = members.filter("members > 2").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    part = scratch.write(part, "near-parts")
    still = scratch.write(part.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key"), "near-open")
    rows = part.join(still, "key", "left_semi").join(light, "rep")
    chunks = F.ceil(F.col("members") / BUCKET_CHUNK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select("key", "comp", "n", "sig", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = rows.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
    alike = scratch.write(dealt.mapInArrow(_alike_components, "a long, b long"), "near-alike")
    scratch.drop(part, still)
    if not alike.isEmpty():
        links = links.unionByName(_between(reps.select("rep"), comp, components(alike), texts))
        comp = components(links)

    copies = reps.filter("copies > 1").select("k1", "k2", "n", "rep")
    out = sigs.select("_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2", "row_key").join(copies.withColumnRenamed("n", "n_shingles"), ["k1", "k2", "n_shingles"], "left")
    out = out.withColumn("rep", F.when(F.col("_id").isNotNull(), F.coalesce("rep", "_id"))).join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("comp", "rep")
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"), *["row_key"] * row_key)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component; all columns stay.

    Rows that repeat id and text count once: one of them stays where the document does.  Different texts under one id
    are one document to :func:`near_duplicates` and stay or go together.  Null ids and documents without words stay.
    An empty table gives an empty result.  Columns of any name may stand beside these.
    """
    found = near_duplicates(docs, id_col, text_col, row_key=True)
    marks = found.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), "row_key", "kept")
    return settle(docs, id_col, F.xxhash64(docs[f"`{text_col}`"]), marks)
