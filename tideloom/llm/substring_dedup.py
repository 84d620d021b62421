"""Suffix-array dedup (operator 5): repeated byte strings, by shards ordered with external induced sorting.

A byte is removed if it lies in a string of ``least`` bytes that also starts in a document with a smaller id.

Texts never move.  They are read three times, in the same parcels of about ``parcel_bytes``:

1. Each window of ``least`` bytes has a minimiser (the ``seed`` bytes in it with the least hash), which equal windows share;
   neighbouring windows of one minimiser form a segment.  A repeated window shares its minimiser and ``seed`` bytes more on one
   side of it.  The hashes of these go to shards, which tell each parcel which of its hashes another text has too.
2. The segments that have such a hash, each content once a parcel with the smallest id there, go to the shard of
   their minimiser.  A shard orders all suffixes of its contents, with common prefixes, by :mod:`induced`; runs of
   suffixes that share ``least`` bytes are one string, won by the smallest id among its documents.  It tells each parcel
   which windows of each content have a winner below the parcel's smallest id.
3. The parcel cuts its texts: all places of a content above the parcel's smallest id go whole, at that id the told windows.

What shards tell is dealt by parcel and written to the shared folder, a file for each parcel, which the next reading
opens; a lost executor's tasks read or write the same files again.  A passage that very many documents share is sent once a
parcel, so no shard grows with its copies.  Input other than a scan of files is written there first, so that all
readings meet the same rows.  The number of shards follows the measured bytes and the measured shared hashes.

Defined cases: null and empty texts have no bytes; repeats inside one document, or in rows that repeat a ``doc_id``, do not count;
a null ``doc_id`` is larger than all others; an empty table gives no row; other columns, whatever their names, are ignored, or
returned unchanged by :func:`remove_repeats`, where bytes of a character that was cut in two go with it; a text longer
than a parcel forms a parcel of its own and is read in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .induced import Store, suffix_order
from .shingles import mix

NO_ID = 2**63 - 1
SEED = 16
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_TO_SEED = np.uint64(pow(_BASE, SEED, 1 << 64))
STRETCH = 1 << 18


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` neighbours, by doubling."""
    done, low = 1, keys
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    rest = width - done
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A polynomial hash of the ``SEED`` (a power of two) bytes from each position on, by doubling lengths."""
    power, length, part = _BASE, 1, data.astype(np.uint64) + np.uint64(1)
    while length < SEED:
        part = part[:-length] * np.uint64(power) + part[length:]
        power = power * power % (1 << 64)
        length *= 2
    return part


def segments(data: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, minimiser's hash and the hashes of its left and right side (0: outside the segment) of all segments.

    ``bounds`` are the places in ``data`` where texts begin, and its end.  A long text is read in stretches; a segment that a
    stretch ends in is cut there, by windows, so none is lost.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    back = np.arange(1, least)
    for lo in range(0, len(data) - least + 1, STRETCH):
        hi = min(len(data), lo + STRETCH + least - 1)
        own = seed_hashes(data[lo:hi])
        mixed = mix(own)
        keys = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(own), dtype=np.uint64)
        anchor = (window_minima(keys, least - SEED + 1) & np.uint64(0xFFFFFFFF)).astype(np.int32)
        # no window reaches over the end of its text
        over = (bounds[np.searchsorted(bounds, lo, "right") : np.searchsorted(bounds, hi, "left")][:, None] - back).reshape(-1) - lo
        valid = np.ones(len(anchor), bool)
        valid[over[(over >= 0) & (over < len(anchor))]] = False
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        inside = np.flatnonzero(valid)
        ends = inside[np.append(np.searchsorted(inside, starts[1:]) - 1, len(inside) - 1)] + least
        a = anchor[starts]
        left, right = a - SEED >= starts, a + 2 * SEED <= ends
        # two seeds side by side: the hash of twice the length
        before = mix(own[np.where(left, a - SEED, 0)] * _BASE_TO_SEED + own[a]) | np.uint64(1)
        after = mix((own[a] * _BASE_TO_SEED + own[np.where(right, a + SEED, 0)]) ^ np.uint64(0x5DEECE66D)) | np.uint64(1)
        before[~left], after[~right] = 0, 0
        place = np.int32 if len(data) < 2**31 else np.int64
        parts.append(((starts + lo).astype(place), (ends + lo).astype(place), mixed[a], before, after))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 3
    columns = [list(c) for c in zip(*parts)]
    parts.clear()
    return tuple(np.concatenate(columns.pop(0)) for _ in range(len(columns)))


@dataclass
class Parcel:
    """Rows that are read together: the table, ids, bytes of the texts with their bounds, and a name by content."""

    table: pa.Table
    ids: np.ndarray
    data: np.ndarray
    bounds: np.ndarray
    name: str


def parcels(batches: Iterable[pa.RecordBatch], id_column: str, text_column: str, parcel_bytes: int) -> Iterator[Parcel]:
    """Cut the rows of a partition into parcels; only the rows decide where, not their batches."""
    import xxhash

    for table in common.blocks(batches, text_column, parcel_bytes):
        ids = pc.fill_null(table.column(id_column), NO_ID).to_numpy()
        data, bounds = common.text_bytes(table.column(text_column))
        digest = xxhash.xxh3_128(ids.tobytes() + bounds.tobytes())
        digest.update(data)
        yield Parcel(table, ids, data, bounds, digest.hexdigest())


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), asbytes=True)


def _sides(parcel: Parcel, found: tuple[np.ndarray, ...], shards: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct side hashes of a parcel as shard and 32 bits, whether two texts here share each, and the number of each segment's two (-1: none)."""
    starts, _, _, before, after = found
    rows = [np.flatnonzero(before).astype(np.int32), np.flatnonzero(after).astype(np.int32)]
    value = np.concatenate([before[rows[0]], after[rows[1]]])
    value >>= np.uint64(24)  # shards in order of the hash
    value *= np.uint64(shards)
    value >>= np.uint64(8)
    order = np.argsort(value, kind="stable").astype(np.int32)  # and within a hash in order of the text, as it comes from one side
    value = value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    first = np.flatnonzero(new)
    value = value[first]
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del new
    text = np.searchsorted(parcel.bounds, starts, "right").astype(np.int32)
    text = np.concatenate([text[rows[0]], text[rows[1]]])[order]
    del order
    own = np.maximum.reduceat(text, first) != np.minimum.reduceat(text, first) if len(first) else np.zeros(0, bool)
    del text, first
    numbers, at = [], 0
    for r in rows:
        column = np.full(len(starts), -1, np.int32)
        column[r] = number[at : at + len(r)]
        numbers.append(column)
        at += len(r)
    return value, own, numbers


def _ask_sides(source: DataFrame, least: int, parcel_bytes: int, shards: int) -> DataFrame:
    """shard, parcel, payload: the side hashes of each parcel, for the shards that compare them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parcel in parcels(batches, "id", "text", parcel_bytes):
            value, _, _ = _sides(parcel, segments(parcel.data, parcel.bounds, least), shards)
            shard = (value >> np.uint64(32)).astype(np.int64)
            low = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
            numbers, first = np.unique(shard, return_index=True)
            out = [_packed(np.diff(part, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for part in np.split(low, first[1:])] if len(first) else []
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([parcel.name] * len(numbers), pa.string()), pa.array(out, pa.binary())], names=["shard", "parcel", "payload"])

    return source.mapInArrow(common.tidied(run), "shard long, parcel string, payload binary")


def _by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[bytes]]]:
    """The parcels and payloads of each shard, which lie together."""
    now, names, held = None, [], []
    for batch in batches:
        for shard, parcel, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "parcel", "payload"))):
            if shard != now and held:
                yield now, names, held
                names, held = [], []
            now = shard
            names.append(parcel)
            held.append(payload)
    if held:
        yield now, names, held


def _answers(asked: DataFrame, shards: int, answer: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """shard, parcel, payload: what each shard tells its parcels; ``answer(payloads)`` gives one or None for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, names, payloads in _by_shard(batches):
            told = [(n, p) for n, p in zip(names, answer(payloads)) if p is not None]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(told), pa.int64()), pa.array([n for n, _ in told], pa.string()), pa.array([p for _, p in told], pa.binary())], names=["shard", "parcel", "payload"])

    dealt = asked.repartition(shards, F.col("shard")).sortWithinPartitions("shard", "parcel")
    return dealt.mapInArrow(common.tidied(run), "shard long, parcel string, payload binary")


def _shared_hashes(payloads: list[bytes]) -> list[bytes]:
    """For each parcel a bit for each of its hashes: another parcel has it too."""
    lists = [np.cumsum(np.frombuffer(_unpacked(p), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1), dtype=np.uint64).astype(np.uint32) for p in payloads]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    out = []
    for own in lists:
        at = np.searchsorted(twice, own)
        hit = np.zeros(len(own), bool)
        inside = at < len(twice)
        hit[inside] = twice[at[inside]] == own[inside]
        out.append(int(hit.sum()).to_bytes(4, "little") + np.packbits(hit).tobytes())
    return out


def _file(folder: str, parcel: str) -> str:
    return f"{folder}/{parcel[:3]}/{parcel}"


def _tell(answers: DataFrame, folder: str, files: int) -> int:
    """Write a file for each parcel with what the shards tell it; gives the sum of the first four bytes of all payloads."""

    def write(name: str, told: dict[int, bytes]) -> None:
        common.write_file(_file(folder, name), b"".join(np.array([shard, len(payload)], "<i8").tobytes() + payload for shard, payload in told.items()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, total = None, {}, 0
        for batch in batches:
            for parcel, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("parcel", "shard", "payload"))):
                if parcel != now and now is not None:
                    write(now, told)
                    told = {}
                now = parcel
                told[shard] = payload
                total += int.from_bytes(payload[:4], "little")
        if now is not None:
            write(now, told)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    dealt = answers.repartition(files, F.col("parcel")).sortWithinPartitions("parcel", "shard")
    return dealt.mapInArrow(common.tidied(run), "n long").agg(F.sum("n")).first()[0] or 0


def _told(folder: str, parcel: str) -> dict[int, bytes] | None:
    """What the shards told a parcel; None if nothing was."""
    try:
        with common.open_in(_file(folder, parcel)) as f:
            raw = f.read()
    except FileNotFoundError:
        return None
    out, at = {}, 0
    while at < len(raw):
        shard, size = np.frombuffer(raw, "<i8", 2, at).tolist()
        out[shard] = raw[at + 16 : at + 16 + size]
        at += 16 + size
    return out


def _shared_segments(parcel: Parcel, least: int, folder: str, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and minimiser's hash of the segments with a side that another text has too."""
    found = segments(parcel.data, parcel.bounds, least)
    value, own, numbers = _sides(parcel, found, shards)
    if not len(value):
        return found[0][:0], found[1][:0], found[2][:0]
    told = _told(folder, parcel.name)
    if told is None:
        raise RuntimeError("the input changed between two readings of it")
    sizes = np.bincount((value >> np.uint64(32)).astype(np.int64), minlength=shards)
    hit = np.concatenate([np.unpackbits(np.frombuffer(told[k], np.uint8, offset=4), count=sizes[k]) for k in np.flatnonzero(sizes).tolist()]).astype(bool) | own
    hit = np.append(hit, False)  # for -1
    marked = hit[numbers[0]] | hit[numbers[1]]
    return found[0][marked], found[1][marked], found[2][marked]


def _contents(parcel: Parcel, starts: np.ndarray, ends: np.ndarray) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct segment contents in order of their first place, the content and id of each place, and the smallest id of each content."""
    number: dict[bytes, int] = {}
    raw = parcel.data.tobytes()
    content = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
    ids = parcel.ids[np.searchsorted(parcel.bounds, starts, "right") - 1]
    smallest = np.full(len(number), NO_ID)
    np.minimum.at(smallest, content, ids)
    return number, content, ids, smallest


def _dealt_contents(hashes: np.ndarray, content: np.ndarray, n: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The contents' numbers by shard, and their shards."""
    shard = np.zeros(n, np.int64)
    shard[content] = (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64) % shards
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


def _ask_contents(source: DataFrame, least: int, parcel_bytes: int, folder: str, side_shards: int, shards: int) -> DataFrame:
    """shard, parcel, payload: the contents of the shared segments of each parcel with the smallest id here."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parcel in parcels(batches, "id", "text", parcel_bytes):
            starts, ends, hashes = _shared_segments(parcel, least, folder, side_shards)
            number, content, _, smallest = _contents(parcel, starts, ends)
            bodies = list(number)
            order, shard = _dealt_contents(hashes, content, len(bodies), shards)
            numbers, first = np.unique(shard, return_index=True)
            out = []
            for own in np.split(order, first[1:]) if len(first) else []:
                parts = [bodies[k] for k in own.tolist()]
                lengths = np.fromiter(map(len, parts), "<u2", len(parts))
                out.append(_packed(len(parts).to_bytes(4, "little") + smallest[own].astype("<i8").tobytes() + lengths.tobytes() + b"".join(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([parcel.name] * len(numbers), pa.string()), pa.array(out, pa.binary())], names=["shard", "parcel", "payload"])

    return source.mapInArrow(common.tidied(run), "shard long, parcel string, payload binary")


def _joined(raw: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Smallest ids, lengths and bytes of the contents in a payload."""
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "<u2", n, 4 + 8 * n), raw[4 + 10 * n :]


def winners(bodies: list[bytes], smallest: np.ndarray, least: int, queue_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For all contents, one after the other with a byte between: the least of ``smallest`` of the string at each place, and where contents begin.

    Where no window starts, the greatest number of the kind of ``smallest`` stands.
    """
    text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)  # a byte that UTF-8 never has
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begin = np.cumsum(sizes + 1) - sizes - 1
    none = np.iinfo(smallest.dtype).max
    with Store(least=queue_bytes) as store:
        suffixes, shared = suffix_order(text, least, store)
        del text
        windows = np.stack([sizes + 1 - least, np.full(len(sizes), least)], axis=1).reshape(-1)
        by = np.repeat(np.stack([smallest, np.full_like(smallest, none)], axis=1).reshape(-1), windows)
        out = np.empty(len(by), smallest.dtype)
        lo = 0
        while lo < len(by):
            hi = min(lo + STRETCH, len(by))
            while hi < len(by) and shared[hi] >= least:  # to the end of a run
                more = np.flatnonzero(shared[hi : hi + STRETCH] < least)
                hi = hi + int(more[0]) if len(more) else min(hi + STRETCH, len(by))
            edge = np.flatnonzero(shared[lo:hi] < least)
            at = suffixes[lo:hi]
            out[at] = np.repeat(np.minimum.reduceat(by[at], edge), np.diff(np.append(edge, hi - lo)))
            lo = hi
    return out, begin


def _judged(payloads: list[bytes], least: int, queue_bytes: int) -> list[bytes | None]:
    """For each parcel a byte for each of its contents, and the runs of windows of those that have some.

    0: no window has a winner below the parcel's smallest id; 1: every window has; 2: the windows of the runs have.
    """
    number: dict[bytes, int] = {}
    asked = []
    for payload in payloads:
        ids, lengths, body = _joined(_unpacked(payload))
        ends = np.cumsum(lengths, dtype=np.int64)
        content = np.fromiter((number.setdefault(body[a:b], len(number)) for a, b in zip((ends - lengths).tolist(), ends.tolist())), np.int32, len(ids))
        asked.append((ids.copy(), content))
    del ids, lengths, body, ends, content
    smallest = np.full(len(number), NO_ID)
    for ids, content in asked:
        np.minimum.at(smallest, content, ids)
    # the order of the ids stands for them, in half their bytes
    order, rank = np.unique(smallest, return_inverse=True)
    bodies = list(number)
    del number, smallest
    winner, begin = winners(bodies, rank.astype(np.int32), least, queue_bytes)
    n_windows = np.fromiter(map(len, bodies), np.int64, len(bodies)) - least + 1
    del bodies, rank
    reach = np.stack([begin, begin + n_windows], axis=1).reshape(-1)
    worst, best = np.maximum.reduceat(winner, reach)[::2], np.minimum.reduceat(winner, reach)[::2]
    out: list[bytes | None] = []
    for ids, content in asked:
        below = np.searchsorted(order, ids)  # of the ranks, those of smaller ids
        code = np.where(worst[content] < below, 1, np.where(best[content] < below, 2, 0)).astype(np.uint8)
        if not code.any():
            out.append(None)
            continue
        counts, runs = [], []
        for k in np.flatnonzero(code == 2).tolist():
            c = content[k]
            hit = np.zeros(int(n_windows[c]) + 2, bool)
            hit[1:-1] = winner[begin[c] : begin[c] + n_windows[c]] < below[k]
            edges = np.flatnonzero(hit[1:] != hit[:-1])
            counts.append(len(edges) // 2)
            runs.append(edges.astype("<u2"))
        flat = np.concatenate(runs) if runs else np.zeros(0, "<u2")
        out.append(bytes(4) + _packed(code.tobytes() + np.array(counts, "<u2").tobytes() + flat.tobytes()))
    return out


def _removed(parcel: Parcel, least: int, side_folder: str, side_shards: int, folder: str, shards: int) -> np.ndarray:
    """The maximal runs of the parcel's bytes to remove, as (start, end); no run goes from one text into the next."""
    starts, ends, hashes = _shared_segments(parcel, least, side_folder, side_shards)
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    told = _told(folder, parcel.name) or {}
    number, content, ids, smallest = _contents(parcel, starts, ends)
    n = len(number)
    del number
    order, shard = _dealt_contents(hashes, content, n, shards)
    numbers, first = np.unique(shard, return_index=True)
    code = np.zeros(n, np.uint8)
    flat: dict[int, np.ndarray] = {}
    for k, own in zip(numbers.tolist(), np.split(order, first[1:])):
        if k not in told:
            continue
        raw = _unpacked(told[k][4:])
        code[own] = np.frombuffer(raw, np.uint8, len(own))
        partly = own[code[own] == 2]
        counts = np.frombuffer(raw, "<u2", len(partly), len(own))
        edges = np.frombuffer(raw, "<u2", 2 * int(counts.sum()), len(own) + 2 * len(partly)).reshape(-1, 2)
        flat.update(zip(partly.tolist(), np.split(edges, np.cumsum(counts, dtype=np.int64)[:-1])))
    # above the parcel's smallest id of a content, that document has all its windows
    whole = (ids > smallest[content]) | (code[content] == 1)
    partly = np.flatnonzero(~whole & (code[content] == 2))
    spans = [np.stack([starts[whole], ends[whole]], axis=1)]
    for k, c in zip(partly.tolist(), content[partly].tolist()):
        spans.append(starts[k] + flat[c].astype(np.int64) + [0, least - 1])
    every = np.concatenate(spans)
    every = every[np.argsort(every[:, 0], kind="stable")]
    return merge(every, parcel.bounds)


def merge(pairs: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
    """The union of (start, end) pairs, which are sorted by start, as maximal runs that end where a text (by ``bounds``) does."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    if bounds is not None:
        new[1:] |= np.diff(np.searchsorted(bounds, pairs[:, 0], "right")) > 0
    at = np.flatnonzero(new)
    return np.stack([pairs[at, 0], reach[np.append(at[1:], len(pairs)) - 1]], axis=1)


def _cut(raw: memoryview, spans: list[list[int]], start: int, end: int) -> bytes:
    """Bytes start to end without the spans, which lie in it."""
    out, at = [], start
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:end])
    return b"".join(out)


def _cut_texts(parcel: Parcel, runs: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """For each text its bytes, removed bytes, runs and what is left."""
    raw = memoryview(parcel.data)
    spans = runs.tolist()
    at = np.searchsorted(runs[:, 0], parcel.bounds).tolist()
    bounds = parcel.bounds.tolist()
    for a, b, i, j in zip(bounds, bounds[1:], at, at[1:]):
        kept = _cut(raw, spans[i:j], a, b)
        yield b - a, b - a - len(kept), j - i, kept


def _judge(source: DataFrame, least: int, parcel_bytes: int, side_hashes: int, shard_bytes: int, queue_bytes: int) -> Callable[[Parcel], np.ndarray]:
    """Both askings over ``source`` (id, text); gives a function from a parcel to the runs to remove."""
    spark = source.sparkSession
    n_bytes = source.select(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = common.shared_dir(spark, "repeats")
    files = max(1, -(-n_bytes // (32 * parcel_bytes)))
    # a minimiser each 18 bytes at random, with up to two sides
    side_shards = max(1, -(-n_bytes // (9 * side_hashes)))
    answers = _answers(_ask_sides(source, least, parcel_bytes, side_shards), side_shards, _shared_hashes)
    shared = _tell(answers, f"{folder}/sides", files)
    # two hashes or fewer a segment, of about 3 * least / 2 bytes at most
    shards = max(1, -(-shared * least // shard_bytes))
    asked = _ask_contents(source, least, parcel_bytes, f"{folder}/sides", side_shards, shards)
    _tell(_answers(asked, shards, lambda payloads: _judged(payloads, least, queue_bytes)), f"{folder}/runs", files)
    return lambda parcel: _removed(parcel, least, f"{folder}/sides", side_shards, f"{folder}/runs", shards)


def _rows(docs: DataFrame) -> DataFrame:
    """id and text of every row."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))


def repeats(docs: DataFrame, least: int = 50, parcel_bytes: int = 8_000_000, side_hashes: int = 2_000_000, shard_bytes: int = 4_000_000, queue_bytes: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    ``least`` is 48 at least, three seeds.  ``side_hashes`` and ``shard_bytes`` are the aims for a shard of either asking;
    queues of ``queue_bytes`` or more are files.
    """
    _checked(least)
    docs = common.replayable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "repeats-input")
    removed = _judge(_rows(docs), least, parcel_bytes, side_hashes, shard_bytes, queue_bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parcel in parcels(batches, "doc_id", "text", parcel_bytes):
            rows = [(n, gone, spans, hashlib.sha256(kept).hexdigest()) for n, gone, spans, kept in _cut_texts(parcel, removed(parcel))]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([parcel.table.column("doc_id").combine_chunks(), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(common.tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, least: int = 50, parcel_bytes: int = 8_000_000, side_hashes: int = 2_000_000, shard_bytes: int = 4_000_000, queue_bytes: int = 1_000_000) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, all other columns as they were.  Null texts stay null."""
    _checked(least)
    docs = common.replayable(docs, "repeats-input")
    removed = _judge(_rows(docs), least, parcel_bytes, side_hashes, shard_bytes, queue_bytes)
    (number,) = common.fresh(docs, "id")
    text_at = [c.lower() for c in docs.columns].index("text")
    text_type = docs.schema[text_at].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parcel in parcels(batches, number, names[text_at], parcel_bytes):
            runs = removed(parcel)
            table = parcel.table.drop_columns([number])
            if len(runs):
                old = table.column(text_at)
                # bytes that were cut off a character go too; a text without runs is as it was
                new = [kept.decode("utf-8", "ignore") if spans else kept.decode("utf-8") for _, _, spans, kept in _cut_texts(parcel, runs)]
                table = table.set_column(text_at, table.schema.field(text_at), pa.array(new, old.type, mask=np.asarray(old.is_null())))
            yield from table.to_batches()

    names = list(docs.columns)
    texts = docs.withColumn("text", F.col("text").cast("string"))
    source = texts.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(number))
    return source.mapInArrow(common.tidied(run), texts.schema).withColumn("text", F.col("text").cast(text_type))


def _checked(least: int) -> None:
    if least < 3 * SEED:
        raise ValueError(f"least must be {3 * SEED} or more")
