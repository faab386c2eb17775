"""Removal of repeated byte strings with anchors and suffix arrays.

Every window of ``WINDOW`` bytes has an anchor: the place of the least hash among its
``GRAM``-byte strings.  Equal windows have equal anchors, so only windows whose anchor's
string occurs twice can repeat, and one row per anchor (about one in 140 bytes) travels
in place of one per byte.  An anchor's slice is the text that all of its windows cover:

* equal slices repeat as a whole, which counting tells;
* different slices with one anchor string are sorted by suffixes in groups, and adjacent
  common prefixes tell which windows repeat;
* an anchor string with very many different slices (a passage that a large share of all
  documents quote) is taken up again with longer and longer anchor strings, a few rows to a slice, until its groups are
  small enough to be sorted; what differs only within the last few bytes is counted window by window.

Windows of one anchor all contain it, hence what they cover is one stretch per slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm import kernels as K
from skein.llm import prune, scratch
from skein.llm.suffix_sort import adjacent_prefixes, sort_suffixes
from skein.llm.text import own_columns

WINDOW = 400
GRAM = 128
#: Anchor strings that large groups are dealt by anew.
LONGER = (256, 384)
#: Different slices of one anchor string that are still sorted in one task.
GROUP = 256
SORT_BYTES = 1 << 19
BLOCK = K.BLOCK_BYTES


def _gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    n = len(sums) - k
    return K.mix((sums[k:] - sums[:-k]) * K.powers(K.INVERSE, n))


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Text index, first and last window start (in the text), anchor hash and slice hash of all anchors of a block."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = K.prefix_sums(data)
    g = _gram_hashes(sums, gram)
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    m = _window_min((g >> bits << bits) | np.arange(len(g), dtype=np.uint64), window - gram + 1)
    at = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    p = at[start]
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(p)])) - 1
    d, a, b = doc[first], start[first], start[last]
    return d, a - offsets[d], b - offsets[d], g[p[first]], K.slice_hashes(sums, a, b + window)


_SIGNED = np.int64


def _find(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            keys = batch.column(0).to_numpy()
            for lo, _, part, at in K.blocks(data, offsets, BLOCK):
                d, a, b, fp, sh = _anchors(part, at, window, gram)
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo + d]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(fp.view(_SIGNED)), pa.array(sh.view(_SIGNED))], ["k", "a", "b", "fp", "sh"])

    return run


def _cut(window: int):
    """Bytes of the slices that a text was asked for; a slice whose hash differs came from another text with the same key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            raw = memoryview(np.ascontiguousarray(data))
            keys = batch.column(0).to_pylist()
            rows: list[tuple] = []
            size = 0
            for r, asked in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[r] : offsets[r + 1]]
                a = np.array([x["a"] for x in asked], np.int64)
                e = np.array([x["b"] for x in asked], np.int64) + window
                fits = e <= len(text)
                sh = np.zeros(len(a), np.uint64)
                sh[fits] = K.slice_hashes(K.prefix_sums(text), a[fits], e[fits])
                good = fits & (sh.view(_SIGNED) == np.array([x["sh"] for x in asked], _SIGNED))
                for i in np.flatnonzero(good).tolist():
                    x = asked[i]
                    rows.append((x["fp"], x["sh"], x["c"], x["hot"], keys[r], x["a"], x["b"], bytes(raw[offsets[r] + a[i] : offsets[r] + e[i]])))
                    size += int(e[i] - a[i])
                if size > 4 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    return run


_CUT = "fp long, sh long, c long, hot boolean, k long, a int, b int, bytes binary"
_CUT_PA = pa.schema([("fp", pa.int64()), ("sh", pa.int64()), ("c", pa.int64()), ("hot", pa.bool_()), ("k", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CUT_PA, strict=True)], schema=_CUT_PA)


def repeated_starts(slices: list[bytes], starts: list[int], window: int) -> list[np.ndarray]:
    """For each slice, which of its first ``starts`` windows occur again among all windows of all slices."""
    lengths = np.array([len(s) for s in slices])
    ends = np.cumsum(lengths + 1) - 1
    t = np.frombuffer(b"\0".join(slices) + b"\0", np.uint8)
    want = np.zeros(len(t), bool)
    begin = ends - lengths
    for b, n in zip(begin.tolist(), starts, strict=True):
        want[b : b + n] = True
    order = sort_suffixes(t, ends, want, window)
    deep = adjacent_prefixes(t, order, window) >= window
    again = np.zeros(len(t), bool)
    again[order[deep]] = True
    again[order[np.flatnonzero(deep) - 1]] = True
    return [np.flatnonzero(again[b : b + n]) for b, n in zip(begin.tolist(), starts, strict=True)]


def _sorted_groups(window: int):
    """Stretches that repeat, from slices that arrive grouped by anchor string."""

    def flush(groups: list[dict]) -> pa.RecordBatch | None:
        rows = [r for g in groups for r in g.values()]
        if not rows:
            return None
        # byte 0 separates the slices; in UTF-8 byte 255 is free to stand for it
        texts = [r[3].replace(b"\0", b"\xff") for r in rows]
        found = repeated_starts(texts, [r[5] - r[4] + 1 for r in rows], window)
        k, lo, hi = [], [], []
        for r, s in zip(rows, found, strict=True):
            if len(s) and r[1] == 1:
                k.append(r[2])
                lo.append(r[4] + int(s[0]))
                hi.append(r[4] + int(s[-1]) + window)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["k", "lo", "hi"]) if k else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict] = []
        now, size = None, 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("fp", "sh", "c", "k", "bytes", "a", "b")]
            for fp, sh, c, k, raw, a, b in zip(*cols, strict=True):
                if fp != now:
                    if size >= SORT_BYTES:
                        if (out := flush(groups)) is not None:
                            yield out
                        groups, size = [], 0
                    groups.append({})
                    now = fp
                if sh not in groups[-1]:
                    groups[-1][sh] = (sh, c, k, raw, a, b)
                    size += len(raw)
        if (out := flush(groups)) is not None:
            yield out

    return run


def _anew(window: int, gram: int):
    """Slices cut by their anchors once more, with longer anchor strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(3))
            keys, starts, counts = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for lo, _, part, at in K.blocks(data, offsets, BLOCK):
                d, a, b, fp, sh = _anchors(part, at, window, gram)
                raw = np.ascontiguousarray(part).tobytes()
                cut = [raw[x:y] for x, y in zip((at[d] + a).tolist(), (at[d] + b + window).tolist(), strict=True)]
                at0 = starts[lo + d]
                cols = [fp.view(_SIGNED), sh.view(_SIGNED), counts[lo + d], keys[lo + d], (at0 + a).astype(np.int32), (at0 + b).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(cut, pa.binary())], ["fp", "sh", "c", "k", "a", "b", "bytes"])

    return run


_ANEW = "fp long, sh long, c long, k long, a int, b int, bytes binary"
_SPAN = "k long, lo int, hi int"


def _large_groups(hot: DataFrame, window: int, group: int) -> list[DataFrame]:
    """Spans of the slices (k, a, c, bytes) of anchor strings with more than ``group`` different slices.

    Slices that stand more than once (c > 1) go as a whole and need no span here; they count against others.
    """
    found = []
    for gram in LONGER:
        if gram >= window or hot.isEmpty():
            continue
        rows = scratch.write(hot.select("k", "a", "c", "bytes").mapInArrow(_anew(window, gram), _ANEW), "suffix-anew")
        twice = scratch.write(rows.groupBy("fp").agg(F.sum("c").alias("n"), F.min("sh").alias("x"), F.max("sh").alias("y")).filter("n > 1").select("fp", (F.col("x") < F.col("y")).alias("mixed")), "suffix-anew-twice")
        shared = scratch.write(rows.join(twice, "fp"), "suffix-anew-shared")
        slices = scratch.write(shared.groupBy("fp", "sh").agg(F.sum("c").alias("c"), F.max("mixed").alias("mixed"), F.min(F.struct("k", "a", "b", "bytes")).alias("r")).select("fp", "sh", "c", "mixed", "r.*"), "suffix-anew-slices")
        several = scratch.write(slices.filter("c > 1").select("fp", "sh"), "suffix-anew-several")
        equal = shared.filter("c = 1").join(several, ["fp", "sh"], "left_semi").select("k", F.col("a").alias("lo"), (F.col("b") + window).cast("int").alias("hi"))
        sizes = slices.filter("mixed").groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("fp", F.lit(True).alias("hot"))
        marked = scratch.write(slices.filter("mixed").join(scratch.write(sizes, "suffix-anew-hot"), "fp", "left"), "suffix-anew-marked")
        few = marked.filter("hot is null").repartition("fp").sortWithinPartitions("fp").mapInArrow(_sorted_groups(window), _SPAN)
        found += [scratch.write(equal, "suffix-anew-equal"), scratch.write(few, "suffix-anew-few")]
        hot = marked.filter("hot").select("k", "a", "c", "bytes")
        scratch.drop(rows, twice, shared, slices, several)
    rows = scratch.write(hot.select("k", "a", "c", "bytes").repartition("k", "a").mapInArrow(_window_hashes(window), "k long, a int, s int, c long, h1 long, h2 long"), "suffix-windows")
    again = scratch.write(rows.groupBy("h1", "h2").agg(F.sum("c").alias("n")).filter("n > 1").select("h1", "h2"), "suffix-again")
    many = rows.join(again, ["h1", "h2"], "left_semi").groupBy("k", "a").agg(F.min("s").alias("x"), F.max("s").alias("y"))
    return [*found, many.select("k", (F.col("a") + F.col("x")).cast("int").alias("lo"), (F.col("a") + F.col("y") + window).cast("int").alias("hi"))]


def _window_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(3).to_pylist()
            cols = [batch.column(i).to_numpy() for i in (0, 1, 2)]
            for r, raw in enumerate(raws):
                data = np.frombuffer(raw, np.uint8)
                h1 = _gram_hashes(K.prefix_sums(data), window)
                h2 = _gram_hashes(K.prefix_sums(data[::-1] ^ np.uint8(0x5A)), window)[::-1]
                n = len(h1)
                k, a, c = (np.repeat(x[r], n) for x in cols)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(a.astype(np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(c), pa.array(h1.view(_SIGNED)), pa.array(h2.copy().view(_SIGNED))], ["k", "a", "s", "c", "h1", "h2"])

    return run


def _join_spans(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((x["lo"], x["hi"]) for x in spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        raw = np.ascontiguousarray(data).tobytes()
        removed, n_spans, digests, places = [], [], [], []
        for r, spans in enumerate(batch.column(2).to_pylist()):
            joined = _join_spans(spans)
            at, end, h = int(offsets[r]), int(offsets[r + 1]), hashlib.sha256()
            base = at
            for lo, hi in joined:
                h.update(raw[at : base + lo])
                at = base + hi
            h.update(raw[at:end])
            removed.append(sum(hi - lo for lo, hi in joined))
            n_spans.append(len(joined))
            digests.append(h.hexdigest())
            places.append([{"lo": lo, "hi": hi} for lo, hi in joined])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests), pa.array(places, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
            ["k", "n_removed", "n_spans", "kept", "spans"],
        )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte of a text's UTF-8 form is removed when a ``window``-byte string that covers it also starts
    anywhere else, in this text or another; spans are the maximal removed stretches.

    Null texts count as empty; texts shorter than the window lose nothing.  Null ids are passed
    on.  Rows that repeat id and text repeat each other, so that they lose all of a text that is long enough.
    An empty table gives an empty result.  Other columns are ignored.
    """
    base = own_columns(docs, id_col, text_col).toDF("_id", "_text").select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
    keyed = base.select("_id", "_text", F.xxhash64("_id", "_text").alias("k"))
    long = keyed.filter(F.octet_length("_text") >= window).select("k", F.encode("_text", "UTF-8").alias("raw"))
    anchors = scratch.write(long.mapInArrow(_find(window, gram), "k long, a int, b int, fp long, sh long"), "suffix-anchors")
    twice = anchors.groupBy("fp").agg(F.count("*").alias("n"), F.min("sh").alias("x"), F.max("sh").alias("y")).filter("n > 1").select("fp", (F.col("x") < F.col("y")).alias("mixed"))
    twice = scratch.write(twice, "suffix-twice")
    shared = scratch.write(anchors.join(twice, "fp"), "suffix-shared")
    scratch.drop(anchors, twice)

    slices = shared.filter("mixed").groupBy("fp", "sh").agg(F.count("*").alias("c"), F.min(F.struct("k", "a", "b")).alias("r"))
    slices = scratch.write(slices.select("fp", "sh", "c", "r.k", "r.a", "r.b"), "suffix-slices")
    sizes = scratch.write(slices.groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("fp", F.lit(True).alias("hot")), "suffix-hot")
    whole = shared.filter("not mixed").select("k", "a", "b")
    several = scratch.write(slices.filter("c > 1").select("fp", "sh"), "suffix-several")
    whole = whole.unionByName(shared.filter("mixed").join(several, ["fp", "sh"], "left_semi").select("k", "a", "b"))
    whole = whole.select("k", F.col("a").alias("lo"), (F.col("b") + window).alias("hi"))

    # texts with a shared anchor, fetched once for both the slices and the removal
    need = scratch.write(shared.select("k").distinct(), "suffix-needed")
    held = scratch.write(prune.may_join(long, "k", need).join(need, "k", "left_semi").dropDuplicates(["k"]), "suffix-texts")
    asked = slices.join(sizes, "fp", "left").select("k", F.struct("fp", "sh", "c", F.coalesce("hot", F.lit(False)).alias("hot"), "a", "b").alias("x")).groupBy("k").agg(F.collect_list("x").alias("asked"))
    cut = scratch.write(held.join(scratch.write(asked, "suffix-asked"), "k").select("k", "raw", "asked").mapInArrow(_cut(window), _CUT), "suffix-cut")

    few = cut.filter("not hot").repartition("fp").sortWithinPartitions("fp").mapInArrow(_sorted_groups(window), _SPAN)
    spans = whole.unionByName(few)
    for more in _large_groups(cut.filter("hot"), window, group):
        spans = spans.unionByName(more)
    spans = spans.groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = scratch.write(spans, "suffix-spans")
    done = scratch.write(held.join(spans, "k").select("k", "raw", "spans").mapInArrow(_apply, "k long, n_removed long, n_spans long, kept string, spans array<struct<lo:int,hi:int>>"), "suffix-done")
    scratch.drop(shared, slices, sizes, several, need, held, cut, spans)

    plain = keyed.select("_id", "k", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2(F.encode("_text", "UTF-8"), 256).alias("plain"))
    out = plain.join(done, "k", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept", "plain").alias("kept_sha256"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<lo:int,hi:int>>)")).alias("spans"),
    )


def cut_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the removed stretches cut from ``text_col``; a character of which only a part is removed stays.

    Ids must tell texts apart.  Other columns, null texts and texts that lose nothing stay as they are.
    """
    found = repeated_spans(docs, id_col, text_col, window).filter("n_removed > 0").select(F.col(id_col).alias("_cut"), F.col("spans").alias("_spans")).dropDuplicates(["_cut"])
    found = scratch.write(found, "suffix-cuts")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, ss in zip(texts, spans, strict=True):
            raw, at, kept = text.encode("utf-8"), 0, []
            for x in ss:
                lo, hi = x["lo"], x["hi"]
                while lo < hi and raw[lo] & 0xC0 == 0x80:  # inside a character: it begins before the stretch
                    lo += 1
                while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                    hi -= 1
                kept.append(raw[at:lo])
                at = max(at, hi)
            out.append((b"".join(kept) + raw[at:]).decode("utf-8"))
        return pd.Series(out)

    joined = docs.join(found, docs[id_col].eqNullSafe(F.col("_cut")) & F.col("_spans").isNotNull(), "left")
    same = joined.filter("_spans is null").select(docs.columns)
    return same.unionByName(joined.filter("_spans is not null").withColumn(text_col, cut(F.col(text_col), F.col("_spans"))).select(docs.columns))
