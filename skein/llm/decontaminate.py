"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items form one automaton.  Document words run through it; the longest
match at each word tells which windows of an item end there.  A vectorised test of word
pairs leaves only the stretches that can hold a window, so the automaton itself sees few
words of a clean corpus.

Items are bounded in number by what people write as tests, yet their size is measured:
beyond ``SHARD_BYTES`` they are dealt to shards, each with an automaton of its own; what
the shards find in a row is united where the row stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm import kernels as K
from skein.llm.text import own_columns

IS_WORD = K.word_set([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
SHARD_BYTES = 4 << 20


def item_words(text: str | None) -> list[bytes]:
    data = K.LOWER[np.frombuffer((text or "").encode("utf-8"), np.uint8)]
    starts, ends, _ = K.words(data, np.array([0, len(data)], np.int64), IS_WORD)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class SuffixAutomaton:
    """Generalised suffix automaton over words.  After :meth:`finish`, ``window_items[state]`` names the
    items that hold the ``window``-word string that ends in a state, and ``whole_items[state]`` the
    (length, items) of shorter items that are suffixes of the state's strings."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: list[set[str]] = [set()]
        self.short: dict[int, dict[int, set[str]]] = {}
        self.ids: list[tuple[str, list[bytes]]] = []

    def _state(self, length: int, nxt: dict[bytes, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.owners.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return cur

    def add(self, item: str, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
        self.ids.append((item, words))

    def finish(self) -> SuffixAutomaton:
        for item, words in self.ids:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if len(words) >= self.window and i + 1 >= self.window:
                    self.owners[self.suffix(state, self.window)].add(item)
            if 0 < len(words) < self.window:
                self.short.setdefault(state, {}).setdefault(len(words), set()).add(item)
        self.ids = []
        return self

    def suffix(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a string in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(position of the last word, length, items) of every occurrence of a window or a short item."""
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(w, 0)
            length = length + 1 if state else 0
            if length >= self.window:
                owners = self.owners[self.suffix(state, self.window)]
                if owners:
                    yield i, self.window, owners
            at = state
            while at > 0 and self.short:
                for n, items in self.short.get(at, {}).items():
                    if n <= length:
                        yield i, n, items
                at = self.link[at]


class Matcher:
    """Automaton plus the tables that find stretches worth streaming."""

    BITS = 22

    def __init__(self, items: list[tuple[str, str | None]], window: int = 13):
        self.auto = SuffixAutomaton(window)
        texts = [(i, w) for i, t in items if (w := item_words(t))]
        for i, w in texts:
            self.auto.add(i, w)
        self.auto.finish()
        self.least = min([window, *(len(w) for _, w in texts)])
        singles = sorted({x for _, w in texts for x in w})
        code = dict(zip(singles, self._hash(singles).tolist(), strict=True))
        self.single = self._table(np.array(list(code.values()), np.uint64))
        pairs = {(code[a], code[b]) for _, w in texts for a, b in zip(w, w[1:], strict=False)}
        self.pair = self._table(self._pairs(np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)))
        self.empty = not texts

    @staticmethod
    def _hash(words: list[bytes]) -> np.ndarray:
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
        return K.slice_hashes(K.prefix_sums(data), ends[:-1], ends[1:])

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return K.mix(a * np.uint64(3) + b)

    def _table(self, hashes: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << self.BITS, bool)
        table[hashes >> np.uint64(64 - self.BITS)] = True
        return table

    def _in(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return table[hashes >> np.uint64(64 - self.BITS)]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]], tuple]:
        """Words per text; for texts with hits the (first, last) words of each occurrence and the items; the words' places."""
        data = K.LOWER[data]
        starts, ends, first = K.words(data, offsets, IS_WORD)
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if len(starts) and not self.empty:
            codes = K.slice_hashes(K.prefix_sums(data), starts, ends)
            live = self._in(self.single, codes)
            joined = np.zeros(len(codes) + 1, bool)  # joined[i]: words i-1 and i can stand together in an item
            joined[1:-1] = live[:-1] & live[1:]
            at = np.flatnonzero(joined)
            joined[at] = self._in(self.pair, self._pairs(codes[at - 1], codes[at]))
            joined[first] = False
            heads = np.flatnonzero(live & ~joined[:-1])
            tails = np.flatnonzero(live & ~joined[1:])
            for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
                if b - a + 1 < self.least:
                    continue
                raw = data[starts[a] : ends[b]].tobytes()
                s0 = int(starts[a])
                run = [raw[s - s0 : e - s0] for s, e in zip(starts[a : b + 1].tolist(), ends[a : b + 1].tolist(), strict=True)]
                row = None
                for i, n, items in self.auto.stream(run):
                    if row is None:
                        row = int(np.searchsorted(first, a, side="right")) - 1
                    spans, owners = found.setdefault(row, ([], set()))
                    spans.append((a + i - n + 1, a + i))
                    owners |= items
        return np.diff(first), found, (starts, ends, first)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed word ranges; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SCHEMA = "_id long, n_words long, words array<struct<first:int,last:int>>, bytes array<struct<first:int,last:int>>, items array<string>"


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Matcher]:
    items = own_columns(benchmark, item_col, text_col).toDF("_item", "_text").select(F.col("_item").cast("string"), F.col("_text")).filter("_text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // SHARD_BYTES))
    for k in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(n)) == k)
        yield Matcher([(r["_item"] if r["_item"] is not None else "", r["_text"]) for r in own.toLocalIterator()], window)


def _judge(docs: DataFrame, benchmark: DataFrame, item_col: str, window: int):
    """A function of a batch's texts: words, hit stretches in words and in bytes, and items, of each text."""
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in _shards(benchmark, item_col, "text", window)]

    def judge(column: pa.Array) -> tuple[np.ndarray, list, list, list]:
        data, offsets = K.flat(column)
        n_words, spans, places, items = [np.zeros(0, np.int64)], [], [], []
        for _, _, part, at in K.blocks(data, offsets):
            found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
            for m in shared:
                counts, own, (starts, ends, first) = m.value.block(part, at)
                for row, (hits, owners) in own.items():
                    old = found.setdefault(row, ([], set()))
                    old[0].extend(hits)
                    old[1].update(owners)
            n_words.append(counts)
            for row in range(len(counts)):
                hit = found.get(row)
                merged = merge(hit[0]) if hit else []
                spans.append([{"first": a - int(first[row]), "last": b - int(first[row])} for a, b in merged])
                places.append([{"first": int(starts[a] - at[row]), "last": int(ends[b] - at[row])} for a, b in merged])
                items.append(sorted(hit[1]) if hit else [])
        return np.concatenate(n_words), spans, places, items

    return judge


def _n_hit(spans: list[list[dict]]) -> np.ndarray:
    return np.array([sum(s["last"] - s["first"] + 1 for s in own) for own in spans], np.int64)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, n_items, items (sorted as strings), spans, contaminated.

    Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z.  A window is
    ``window`` consecutive words of an item, or a whole shorter item; a word inside an occurrence of a
    window is hit; spans are the maximal hit stretches as byte ranges of the text.  A document
    is contaminated when it has hits and at least a twentieth of its words are hit.

    Null or wordless texts have no words and no hits.  Null items and items without words
    match nothing; items with one text are all named; null item ids are named "".  Repeated rows and null ids
    give a row each.  Without items nothing is hit.  Other columns are ignored.
    """
    base = own_columns(docs, id_col, text_col).toDF("_id", "_text")
    kind = base.schema["_id"].dataType
    judge = _judge(docs, benchmark, item_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            n_words, spans, places, items = judge(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(places, span), pa.array(items, pa.list_(pa.string()))],
                ["_id", "n_words", "words", "bytes", "items"],
            )

    found = base.mapInArrow(run, _SCHEMA.replace("_id long", f"_id {kind.simpleString()}"))
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda acc, s: acc + (s["last"] - s["first"] + 1))
    out = found.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.col("bytes").alias("spans"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def items_digest(items) -> object:
    return F.sha2(F.array_join(items, ","), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13) -> DataFrame:
    """``docs`` without contaminated documents; all columns and all other rows stay as they are.

    Each row is judged where it stands, by its own text: null and repeated ids do not matter, null texts stay, an
    empty table gives an empty result, and columns of any name may stand beside these.
    """
    judge, place = _judge(docs, benchmark, item_col, window), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, _, _ = judge(batch.column(place))
            hit = _n_hit(spans)
            yield batch.filter(pa.array((hit == 0) | (20 * hit < n_words)))

    return docs.mapInArrow(run, docs.schema)


def cut_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cover: float = 0.05, item_col: str = "item_id", window: int = 13) -> DataFrame:
    """``docs`` with hit spans cut out of the text; documents whose hit share exceeds ``max_cover`` go entirely.

    Each row is judged where it stands, as in :func:`drop_contaminated`; texts without hits and null texts stay as they are.
    """
    judge, place = _judge(docs, benchmark, item_col, window), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, places, _ = judge(batch.column(place))
            hit = _n_hit(spans)
            texts = batch.column(place).to_pylist()
            for row in np.flatnonzero(hit).tolist():
                raw, at, kept = texts[row].encode("utf-8"), 0, []
                for s in places[row]:
                    kept.append(raw[at : s["first"]])
                    at = s["last"]
                texts[row] = (b"".join(kept) + raw[at:]).decode("utf-8")
            columns = [pa.array(texts, batch.schema.field(place).type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(hit <= max_cover * n_words))

    return docs.mapInArrow(run, docs.schema)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
