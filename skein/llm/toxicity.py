"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and word beginnings of three to six bytes, hashed.  The machine adds to the
linear weights a weight for each pair of terms, the product of two short vectors, so that
terms can count together that do not count alone.  Terms enter it in two ways: those whose share differs between
the labels, and those of pairs that stand together under one label more often than their shares make likely, whether or not
either of them tells anything alone.  It is fitted on a bounded sample
of labelled rows; scoring streams whole texts and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm import kernels as K
from skein.llm.text import own_columns

#: Letters a-z and all non-ASCII bytes make words.
IS_WORD = K.word_set([(0x00, 0x60), (0x7B, 0x7F)])
HASH_BITS = 22
PREFIXES = (3, 4, 5, 6)
#: Bounds of the training sample: rows with label 1, rows with label 0.
SAMPLE = (2000, 4000)
MAX_TERMS = 2048
LEAST_Z = 4.0
#: Terms, the most evenly spread ones, whose pairs are looked at; pairs that enter; least difference of a pair in standard errors.
PAIR_TERMS = 2048
MAX_PAIRS = 128
LEAST_PAIR_Z = 7.0
#: Weight of a row with label 1 in the fit, for each row with label 0.
POSITIVE_WEIGHT = 10.0
RANK = 8
STEPS = 300
REJECT = 0.7


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hashed term) of all terms of a block, with repeats."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets, IS_WORD)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sums = K.prefix_sums(data)
    docs, found = [doc], [K.slice_hashes(sums, starts, ends) >> np.uint64(64 - HASH_BITS)]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        h = K.slice_hashes(sums, starts[long], starts[long] + n) + np.uint64(n)
        docs.append(doc[long])
        found.append(K.mix(h) >> np.uint64(64 - HASH_BITS))
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


@dataclass
class Machine:
    """Weights by slot; ``slots`` maps a hashed term to its slot, or to -1."""

    slots: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        slot = self.slots[term].astype(np.int64)
        known = slot >= 0
        width = len(self.linear)
        cell = np.unique(doc[known] * width + slot[known]) if width else np.zeros(0, np.int64)
        d, s = cell // max(1, width), cell % max(1, width)
        z = np.full(n, self.bias)
        if len(cell):
            z += np.bincount(d, self.linear[s], n)
            for f in self.factors.T:
                v = f[s]
                z += (np.bincount(d, v, n) ** 2 - np.bincount(d, v * v, n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _indicators(rows: list[np.ndarray], slots: np.ndarray, width: int) -> np.ndarray:
    """1 where a row has the term of a slot."""
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        s = slots[r]
        x[i, s[s >= 0]] = 1
    return x


def _paired(rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Terms of the pairs whose common occurrence, beyond what their shares make likely, differs most between the labels."""
    spread = share * (1 - share)
    terms = np.sort(seen[np.argsort(-spread, kind="stable")[:PAIR_TERMS]])
    slots = np.full(1 << HASH_BITS, -1, np.int16)
    slots[terms] = np.arange(len(terms))
    beyond, wobble = [], 0.0
    for y in (0, 1):
        x = _indicators([r for r, l in zip(rows, labels, strict=True) if l == y], slots, len(terms))
        x -= x.mean(axis=0)
        beyond.append(x.T @ x / len(x))
        alone = (x * x).mean(axis=0)
        wobble = wobble + np.outer(alone, alone) / len(x)
    z = np.abs(beyond[1] - beyond[0]) / np.sqrt(np.maximum(wobble, 1e-12))
    z = np.triu(z, 1)
    best = np.argsort(-z, axis=None, kind="stable")[:MAX_PAIRS]
    best = best[z.reshape(-1)[best] >= LEAST_PAIR_Z]
    return np.union1d(terms[best // len(terms)], terms[best % len(terms)])


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """A machine from each row's distinct hashed terms.  Without rows of both labels it always gives the share of label 1."""
    size, pos, neg = 1 << HASH_BITS, int(labels.sum()), int((1 - labels).sum())
    slots = np.full(size, -1, np.int16)
    if not pos or not neg:
        share = pos / max(1, pos + neg)
        return Machine(slots, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(0), np.zeros((0, RANK)))
    per_label = [np.unique(np.concatenate([r for r, l in zip(rows, labels, strict=True) if l == y]), return_counts=True) for y in (0, 1)]
    seen = np.union1d(per_label[0][0], per_label[1][0])
    counts = [np.zeros(len(seen)), np.zeros(len(seen))]
    for c, (t, n) in zip(counts, per_label, strict=True):
        c[np.searchsorted(seen, t)] = n
    p, q = counts[1] / pos, counts[0] / neg
    pooled = (counts[0] + counts[1]) / (pos + neg)
    z = np.abs(p - q) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / pos + 1 / neg))
    best = np.argsort(-z, kind="stable")[:MAX_TERMS]
    chosen = np.union1d(seen[best[z[best] >= LEAST_Z]], _paired(rows, labels, seen, pooled))
    slots[chosen] = np.arange(len(chosen))
    x = _indicators(rows, slots, len(chosen))
    y = labels.astype(np.float32)
    weight = np.where(y == 1, POSITIVE_WEIGHT, 1.0).astype(np.float32)
    weight /= weight.sum()
    rng = np.random.default_rng(seed)
    w = [np.zeros(1, np.float32), np.zeros(len(chosen), np.float32), rng.normal(0, 0.01, (len(chosen), RANK)).astype(np.float32)]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in w]
    for step in range(1, STEPS + 1):
        xv = x @ w[2]
        out = w[0] + x @ w[1] + ((xv**2).sum(1) - x @ (w[2] ** 2).sum(1)) / 2
        g = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y) * weight
        gx = x.T @ g
        grads = [g.sum(keepdims=True), gx + 1e-4 * w[1], x.T @ (g[:, None] * xv) - gx[:, None] * w[2] + 1e-3 * w[2]]
        for a, d, (m, v) in zip(w, grads, moments, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            a -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Machine(slots, float(w[0][0]), w[1].astype(np.float64), w[2].astype(np.float64))


def held_out(doc_id) -> object:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Machine:
    """Fits on at most ``sample`` rows of each label, the first by a hash of the id, none of them held out.

    Rows without label or id are ignored, as are labels without a document; an id with several labels counts by the larger one.
    """
    known = own_columns(labels, id_col, label_col).toDF("_id", "_y").filter("_id is not null and _y in (0, 1)")
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = known.filter("_y = 1").orderBy(*order).limit(sample[0]).unionByName(known.filter("_y = 0").orderBy(*order).limit(sample[1]))
    base = own_columns(docs, id_col, text_col).toDF("_id", "_text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(2))
            for lo, hi, part, at in K.blocks(data, offsets):
                doc, term = terms(part, at)
                cell = np.unique((doc << HASH_BITS) | term)
                ends = np.searchsorted(cell, np.arange(1, hi - lo + 1) << HASH_BITS)
                rows = np.split((cell & ((1 << HASH_BITS) - 1)).astype(np.int32), ends[:-1])
                packed = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), packed], ["_id", "_y", "terms"])

    kind = base.schema["_id"].dataType.simpleString()
    joined = base.join(F.broadcast(picked), "_id").select("_id", F.col("_y").cast("int").alias("_y"), "_text")
    rows = sorted(joined.mapInArrow(featurise, f"_id {kind}, _y int, terms binary").collect(), key=lambda r: (r["_id"], r["terms"]))
    return fit([np.frombuffer(r["terms"], np.int32) for r in rows], np.array([r["_y"] for r in rows], np.int64))


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score (0 to 1) and predicted (1 from 0.7 on), one row per input row.

    Null and empty texts get the score that no term moves.  Repeated rows get equal scores, null
    ids are passed on, an empty table gives an empty result, other columns are ignored.
    """
    base = own_columns(docs, id_col, text_col).toDF("_id", "_text")
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            scores = [shared.value.score(*terms(part, at), hi - lo) for lo, hi, part, at in K.blocks(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["_id", "score"])

    kind = base.schema["_id"].dataType.simpleString()
    scored = base.mapInArrow(run, f"_id {kind}, score double")
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", machine: Machine | None = None) -> DataFrame:
    """``docs`` without the documents whose score is 0.7 or more; all columns and other documents stay as they are.

    Texts are scored in place, next to the columns they came with, so nothing is joined or shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine or train(docs, labels, id_col, text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(place))
            for lo, hi, part, at in K.blocks(data, offsets):
                keep = shared.value.score(*terms(part, at), hi - lo) < REJECT
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
