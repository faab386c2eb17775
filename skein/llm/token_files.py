"""Token ids in Arrow files of equal-length sequences with masks.

Documents are dealt to shards by ranges of their id.  Each shard is one Arrow IPC file whose
record batches hold two fixed-size lists, ``ids`` and ``mask``: a sequence is found by its
number alone and is read from a memory map without a copy.  A second file names each
document's place.  The last sequence of a shard is padded with 0 and masked there.

Texts are cut into the pieces that the byte-level tokenizer itself would cut, and a piece
that was met before is not encoded again.  The cut is written for Latin letters; a text with
any other character outside a known-safe set goes to the tokenizer as a whole.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.llm import scratch
from skein.llm.text import own_columns

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 256
END_ID = 0
SHARD_BYTES = 24 << 20
CACHE_PIECES = 500_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Cuts of the byte-level tokenizer, for texts without the characters below.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_UNSAFE = re.compile(rf"[^\x20-\x7e\n\t\r{_LETTERS}‐-‧]")


class Encoder:
    """Encodes texts as little-endian unsigned ids, of 16 bits where the vocabulary allows and of 32 bits otherwise."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(id_dtype(self.tokenizer.get_vocab_size()))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache: dict[str, bytes] = {}
        lone = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_break = lone[0] if len(lone) == 1 else None

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if _UNSAFE.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        pieces, cache = _PIECE.findall(text), self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        if new := set(pieces).difference(cache):
            self._learn(list(new))
        return b"".join(map(cache.__getitem__, pieces))

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces in one call, a line each: the break is a piece and one id of its own, which no other piece holds."""
        lines = [p for p in new if not p.isspace()]
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, self.dtype) if lines else np.zeros(0, self.dtype)
        cuts = np.flatnonzero(ids == self.line_break) if self.line_break is not None else []
        if len(cuts) == len(lines) - 1:
            raw, width = ids.tobytes(), self.dtype.itemsize
            at = 0
            for p, cut in zip(lines, [*cuts.tolist(), len(ids)], strict=True):
                self.cache[p] = raw[at * width : cut * width]
                at = cut + 1
        for p in new:
            if p not in self.cache:
                self.cache[p] = self._whole(p)


#: One encoder for each Python worker, so that tasks share what was learnt.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def file_schema(sequence: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


def _sequences(ids: np.ndarray, n_real: int, sequence: int) -> pa.RecordBatch:
    mask = np.arange(len(ids)) < n_real
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(ids), sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence)],
        schema=file_schema(sequence, ids.dtype),
    )


def _open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write_shard(folder: str, tokenizer: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        files, root = _open_fs(folder)
        files.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        # a name of its own for every attempt: a task that runs twice never writes into a file that is read
        stem = f"{part:06d}-{uuid.uuid4().hex[:8]}"
        encoder = encoder_of(tokenizer)
        dtype = encoder.dtype
        index: list[tuple[object, int, int]] = []
        total, held, held_n, step = 0, [], 0, sequence * SEQUENCES_PER_BATCH
        kind = None
        with files.open_output_stream(f"{root}/{stem}.ids.arrow") as sink, pa.ipc.new_file(sink, file_schema(sequence, dtype)) as writer:
            for batch in batches:
                kind = batch.schema.field(0).type
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = np.frombuffer(encoder.encode(text.as_py() or ""), dtype)
                    index.append((key.as_py(), total, len(ids) + 1))
                    held += [ids, np.array([END_ID], dtype)]
                    held_n += len(ids) + 1
                    total += len(ids) + 1
                    if held_n >= step:
                        flat = np.concatenate(held)
                        full = held_n // step * step
                        for at in range(0, full, step):
                            writer.write_batch(_sequences(flat[at : at + step], step, sequence))
                        held, held_n = [flat[full:]], held_n - full
            if held_n:
                flat = np.concatenate(held)
                padded = np.zeros(-(-held_n // sequence) * sequence, dtype)
                padded[:held_n] = flat
                writer.write_batch(_sequences(padded, held_n, sequence))
        if not index:
            files.delete_file(f"{root}/{stem}.ids.arrow")
            return
        docs = pa.table({"id": pa.array([i for i, _, _ in index], kind), "first": pa.array([a for _, a, _ in index], pa.int64()), "n": pa.array([n for _, _, n in index], pa.int64())})
        with files.open_output_stream(f"{root}/{stem}.docs.arrow") as sink, pa.ipc.new_file(sink, docs.schema) as writer:
            writer.write_table(docs)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([stem]), pa.array([total]), pa.array([len(index)])], ["shard", "stem", "n_tokens", "n_docs"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Writes the ids of all texts, each closed by id 0, in ascending id order, and returns the shards: shard, stem, n_tokens, n_docs, base.

    ``folder`` is a URI that executors can write to; ``base`` counts the ids in all shards before.
    Null texts count as empty and still get their closing id.  Null ids come first.  Repeated rows are written
    each.  An empty table gives no shards.  Other columns are ignored.
    """
    base = own_columns(docs, id_col, text_col).toDF("_id", "_text")
    size = base.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n")).first()["n"]
    dealt = base.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "_id").sortWithinPartitions("_id")
    shards = scratch.write(dealt.mapInArrow(_write_shard(folder, tokenizer, sequence), "shard int, stem string, n_tokens long, n_docs long"), "token-shards")
    # a row per shard, not per document
    counts, at = [], 0
    for r in sorted(shards.toLocalIterator(), key=lambda r: r["shard"]):
        counts.append((r["shard"], r["stem"], r["n_tokens"], r["n_docs"], at))
        at += r["n_tokens"]
    return docs.sparkSession.createDataFrame(counts, "shard int, stem string, n_tokens long, n_docs long, base long")


def open_sequences(folder: str, stem: str) -> pa.ipc.RecordBatchFileReader:
    """A shard's sequences; local files are mapped, not read."""
    files, root = _open_fs(folder)
    path = f"{root}/{stem}.ids.arrow"
    from pyarrow import fs

    source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
    return pa.ipc.open_file(source)


def read_sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a shard; the ids are a view of the file."""
    batch = reader.get_batch(number // SEQUENCES_PER_BATCH)
    row = number % SEQUENCES_PER_BATCH
    ids, mask = batch.column(0), batch.column(1)
    n = ids.type.list_size
    return ids.flatten().to_numpy()[row * n : (row + 1) * n], mask.flatten().to_numpy(zero_copy_only=False)[row * n : (row + 1) * n]


def read_token_files(shards: DataFrame, folder: str, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files alone: ``id_col``, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open_fs(folder)
        for batch in batches:
            for stem, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = open_sequences(folder, stem)
                parts = [reader.get_batch(i) for i in range(reader.num_record_batches)]
                ids = np.concatenate([p.column(0).flatten().to_numpy() for p in parts])
                real = np.concatenate([p.column(1).flatten().to_numpy(zero_copy_only=False) for p in parts])
                with files.open_input_file(f"{root}/{stem}.docs.arrow") as f:
                    docs = pa.ipc.open_file(f).read_all()
                first, n = docs["first"].to_numpy(), docs["n"].to_numpy()
                if int(real.sum()) != int(n.sum()) or not real[: int(n.sum())].all():
                    raise ValueError(f"mask and index of {stem} disagree")
                crc = [zlib.crc32(ids[a : a + m].astype("<u4")) for a, m in zip(first.tolist(), n.tolist(), strict=True)]
                yield from pa.table({"_id": docs["id"], "start": pa.array(first + base), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}).to_batches()

    spread = shards.select("stem", "base").repartition(F.col("stem"))
    return spread.mapInArrow(run, f"_id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Writes the files to the shared folder and reads each document back from them."""
    folder = scratch.new_path(docs.sparkSession, "tokens")
    shards = write_token_files(docs, folder, tokenizer, id_col, text_col, sequence)
    return read_token_files(shards, folder, docs.schema[id_col].dataType.simpleString(), id_col)


