"""Token-ID binary output (operator 3): patched frame-of-reference blocks.

Documents are encoded, ended by an end id and written, in ascending ``doc_id`` order, to shard files.  A
shard packs its ids in blocks of 256: the block minimum is subtracted, the differences are packed at the
width that holds ``fit`` of them, and the high bits of the others go to an exception list.  The footer
indexes block starts, so any range of ids can be decoded alone.

File layout (little-endian)::

    b"PFR1"
    blocks      per block: min u32, width u8, n_exceptions u16, packed low bits (256 * width / 8 bytes),
                exception positions u8 * n, exception high bits u32 * n
    footer      block starts u64 * n_blocks, doc ids i64 * n_docs, null flags u8 * n_docs,
                lengths u64 * n_docs
    trailer     n_blocks u64, n_docs u64, n_tokens u64, footer start u64, b"PFR1"

Defined cases: a null or empty text is a document of the end id alone; a null ``doc_id`` sorts first and
is flagged; repeated ids stay, in any order among themselves; an empty table gives no shard and no row;
other columns of the input are ignored.  Shards carry the number of the task attempt in their names and
only the index rows that Spark commits name them, so a lost or repeated task leaves no wrong shard behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .wordbpe import encoder

MAGIC = b"PFR1"
BLOCK = 256
#: Ids in a shard; a longer document has a shard of its own.
SHARD_TOKENS = 4_000_000
_STEP = 1024  # blocks that are packed at once


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below 2**width to rows of packed bytes."""
    rows = len(values)
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(rows, BLOCK, 4), axis=2)
    return np.packbits(bits[:, :, 32 - width :].reshape(rows, BLOCK * width), axis=1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    rows = len(packed)
    bits = np.zeros((rows, BLOCK, 32), np.uint8)
    bits[:, :, 32 - width :] = np.unpackbits(packed, axis=1).reshape(rows, BLOCK, width)
    return np.packbits(bits, axis=2).view(">u4").reshape(rows, BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray, fit: float = 0.95) -> tuple[bytes, np.ndarray]:
    """Packed blocks of ``ids`` (the last one is filled with its own last id) and their start offsets."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    whole = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1], np.uint32)]).reshape(-1, BLOCK)
    out: list[bytes] = []
    for at in range(0, len(whole), _STEP):
        part = whole[at : at + _STEP]
        low = part.min(axis=1)
        diff = part - low[:, None]
        bits = _bit_lengths(diff)
        widths = np.sort(bits, axis=1)[:, min(BLOCK - 1, int(BLOCK * fit))]
        made: list[bytes] = [b""] * len(part)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            w = int(width)
            d = diff[rows]
            packed = _pack(d & np.uint32((1 << w) - 1), w) if w else np.zeros((len(rows), 0), np.uint8)
            over = bits[rows] > w
            for k, row in enumerate(rows):
                where = np.flatnonzero(over[k])
                high = d[k, where] >> np.uint32(w)
                made[row] = struct.pack("<IBH", low[row], w, len(where)) + packed[k].tobytes() + where.astype(np.uint8).tobytes() + high.astype("<u4").tobytes()
        out += made
    sizes = np.fromiter(map(len, out), np.uint64, len(out))
    return b"".join(out), np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes)[:-1]])


def decode_blocks(data: bytes, starts: np.ndarray, n_tokens: int) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``data``."""
    n = len(starts)
    out = np.empty((n, BLOCK), np.uint32)
    heads = [struct.unpack_from("<IBH", data, int(s)) for s in starts]
    low = np.array([h[0] for h in heads], np.uint32)
    widths = np.array([h[1] for h in heads], np.int64)
    raw = np.frombuffer(data, np.uint8)
    for width in np.unique(widths):
        w = int(width)
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), _STEP):
            some = rows[at : at + _STEP]
            if w:
                inside = starts[some].astype(np.int64)[:, None] + 7 + np.arange(BLOCK * w // 8)
                out[some] = _unpack(raw[inside], w)
            else:
                out[some] = 0
    for i, (_, w, k) in enumerate(heads):
        if k:
            at = int(starts[i]) + 7 + BLOCK * w // 8
            where = raw[at : at + k]
            high = np.frombuffer(data, "<u4", k, at + k)
            out[i, where] |= high << np.uint32(w)
    out += low[:, None]
    return out.reshape(-1)[:n_tokens]


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, fit: float = 0.95) -> bytes:
    """A whole shard file."""
    body, starts = encode_blocks(ids, fit)
    footer = (
        (starts + np.uint64(4)).astype("<u8").tobytes()
        + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], np.uint8).tobytes()
        + np.array(lengths, "<u8").tobytes()
    )
    return MAGIC + body + footer + struct.pack("<QQQQ", len(starts), len(doc_ids), len(ids), 4 + len(body)) + MAGIC


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, lengths and ids of a shard file."""
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a shard of token ids")
    n_blocks, n_docs, n_tokens, at = struct.unpack_from("<QQQQ", data, len(data) - 36)
    starts = np.frombuffer(data, "<u8", n_blocks, at)
    at += 8 * n_blocks
    doc_ids = np.frombuffer(data, "<i8", n_docs, at).tolist()
    nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    for i in np.flatnonzero(nulls):
        doc_ids[i] = None
    return doc_ids, lengths, decode_blocks(data, starts, n_tokens)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, fit: float = 0.95, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards in ``folder``; returns the lazy index, one row per shard.

    Index: path, part (of the range order), seq (within it), n_docs, n_tokens, n_bytes.  The index must be
    stored before it is used, since each evaluation writes shards of its own.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = encoder(vocabulary), TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        end = int(end_id).to_bytes(4, "little")
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        rows: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, doc_ids, size
            path = f"{folder}/shard-{part:06d}-{len(rows):06d}-{attempt}.pfr"
            lengths = [len(h) // 4 for h in held]
            data = shard_bytes(doc_ids, lengths, np.frombuffer(b"".join(held), "<u4"), fit)
            with common.open_out(path) as f:
                f.write(data)
            rows.append((path, part, len(rows), len(held), size, len(data)))
            held, doc_ids, size = [], [], 0

        for table in common.blocks(batches):
            for doc_id, text in zip(table.column("doc_id").to_pylist(), common.texts_of(table)):
                ids = enc.encode(text) + end
                if size and size + len(ids) // 4 > shard_tokens:
                    flush()
                held.append(ids)
                doc_ids.append(doc_id)
                size += len(ids) // 4
        if held:
            flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "part", "seq", "n_docs", "n_tokens", "n_bytes"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(common.tidied(write, cycles=False, keeps=True), "path string, part long, seq long, n_docs long, n_tokens long, n_bytes long")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all shards before each.  Sums by part first, so one task orders parts only."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return index.join(before, "part").withColumn("start", F.col("before") + inside).drop("before")


def read_shards(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files that ``index`` names."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with common.open_in(path) as f:
                    doc_ids, lengths, ids = read_shard(f.read())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * int(e - n) : 4 * int(e)]) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = index.select("path", "start").repartition(F.col("path"))
    return spread.mapInArrow(common.tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write all of ``docs`` to shards, read them back and return a row per document."""
    folder = folder or common.shared_dir(docs.sparkSession, "token-shards")
    index = common.stored(write_shards(docs, folder, vocabulary, end_id), "token-index")
    return read_shards(with_starts(index))
