"""Packing (operator 9): best-fit decreasing over a segment tree of remaining capacities.

Documents are encoded and ended by an end id.  Within a block of about ``BLOCK_TOKENS`` ids, documents longer than
a window are first cut into full windows; the other pieces are placed by falling length into the
open window with the least room that holds them, found by descending a segment tree whose leaf ``c`` counts
the open windows with ``c`` ids of room.  A window that stays more than ``slack`` ids short is then cut at powers
of two (a sequence of such a length needs no padding), so a block leaves almost no padding behind.

No shuffle is needed: blocks are independent and a sequence id is (task number << 32) + number in the task.

Defined cases: a null or empty text is the end id alone; null and repeated ``doc_id`` are carried through,
each row a document of its own; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordbpe import encoder, forget

#: Ids that are packed together.
BLOCK_TOKENS = 4_000_000


class Rooms:
    """Multiset of remaining capacities 0..window with 'least capacity of at least n' by a segment tree."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int = 1) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room of at least ``need``, or -1."""
        count, i = self.count, need + self.size
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.size:
                    i *= 2
                    if not count[i]:
                        i += 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of item numbers; every length is at most ``window``.  Ties go by item number."""
    rooms = Rooms(window)
    open_windows: dict[int, list[int]] = {}
    windows: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        room = rooms.tightest(n)
        if room < 0:
            which, room = len(windows), window
            windows.append([])
        else:
            which = open_windows[room].pop()
            rooms.add(room, -1)
        windows[which].append(item)
        if room - n:
            open_windows.setdefault(room - n, []).append(which)
            rooms.add(room - n)
    return windows


def pack_lengths(lengths: list[int], window: int = 4096, slack: int = 64) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document number, start, length); each id of each document is in one piece."""
    full, rest = [], []
    for doc, n in enumerate(lengths):
        for at in range(0, n - n % window, window):
            full.append([(doc, at, window)])
        if n % window:
            rest.append((doc, n - n % window, n % window))
    for items in best_fit_decreasing([p[2] for p in rest], window):
        pieces = [rest[i] for i in items]
        used = sum(p[2] for p in pieces)
        if window - used <= slack or used & (used - 1) == 0:
            full.append(pieces)
            continue
        todo = pieces[::-1]
        for bit in reversed(range(used.bit_length())):
            if used >> bit & 1:
                room, own = 1 << bit, []
                while room:
                    doc, at, n = todo.pop()
                    if n > room:
                        todo.append((doc, at + room, n - room))
                        n = room
                    own.append((doc, at, n))
                    room -= n
                full.append(own)
    return full


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, slack: int = 64, block_tokens: int = BLOCK_TOKENS, memo_size: int = 500_000) -> DataFrame:
    """One row per piece; see the module's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, base = encoder(vocabulary, memo_size), TaskContext.get().partitionId() << 32
        end = int(end_id).to_bytes(4, "little")
        held: list[bytes] = []
        ids: list[int | None] = []
        made = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, made, size
            lengths = [len(h) // 4 for h in held]
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for pieces in pack_lengths(lengths, window, slack):
                offset = 0
                for doc, at, n in pieces:
                    crc = zlib.crc32(memoryview(held[doc])[4 * at : 4 * (at + n)])
                    for col, v in zip(cols, (ids[doc], at, n, crc, lengths[doc], base + made, offset)):
                        col.append(v)
                    offset += n
                made += 1
            held, ids, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for table in common.blocks(batches):
            for doc_id, text in zip(table.column("doc_id").to_pylist(), common.texts_of(table)):
                held.append(enc.encode(text) + end)
                ids.append(doc_id)
                size += len(held[-1]) // 4
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidied(run, forget, cycles=False), SCHEMA)
