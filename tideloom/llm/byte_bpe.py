"""Byte-level BPE (operator 10): corpus-level merge replay over the distinct words of a block.

A task treats each block of texts as a corpus: the matches of the split pattern are collected, and every
distinct one that is not in the memo becomes a chain of byte symbols in one flat array.  An inverted index
holds, for each merge rank, the positions of its token pair.  Ranks are replayed in rising order; a merge
rewrites its positions, left to right, and files only the two touched neighbours under their own ranks.  A
merge that would arise below the current rank is taken up at once, so each word sees the lowest rank
first, as a word-by-word encoder does.

Blocks, not the whole input, are the corpus on purpose: a global word table grows with the data and would
have to be joined to every word of every text.  Frequent words stay in a bounded memo between blocks.

Defined cases: null and empty texts have no ids and decode to nothing; special tokens are not
recognised; repeated rows are encoded each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a tiktoken file."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes lists of distinct words; ``tokens`` decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte_array = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}  # left id * size + right id -> rank of the merged token
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a = ranks.get(t[:cut])
                if a is not None and (b := ranks.get(t[cut:])) is not None:
                    self.pairs[a * self.size + b] = r

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers, by replaying the merges over all words together."""
        if not words:
            return []
        size, get, tokens = self.size, self.pairs.get, self.tokens
        raw = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        n = len(raw)
        first = self.byte_array[raw]
        first[ends] = -1  # walls: no pair has one
        found = self.byte_pairs[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        found[ends[:-1]] = -1
        found[ends[ends > 0] - 1] = -1
        at = np.flatnonzero(found >= 0)
        at = at[np.argsort(found[at], kind="stable")]
        ranks, cuts = np.unique(found[at], return_index=True)
        index: dict[int, list[int]] = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(at, cuts[1:]))}
        sym: list[int] = first.tolist()
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        queue = list(index)  # sorted, so a heap
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            rank = pop(queue)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            base = rank * size
            for i in positions:
                a = sym[i]
                if a < 0:
                    continue
                j = right[i]
                b = sym[j]
                if b < 0 or get(a * size + b) != rank:
                    continue
                sym[i] = rank
                sym[j] = -2  # merged away
                right[i] = k = right[j]
                left[k] = i
                c = sym[k]
                if c >= 0 and (r := get(base + c)) is not None:
                    if (filed := index.get(r)) is None:
                        index[r] = [i]
                        push(queue, r)
                    else:
                        filed.append(i)
                h = left[i]
                if h >= 0 and (c := sym[h]) >= 0 and (r := get(c * size + rank)) is not None:
                    if (filed := index.get(r)) is None:
                        index[r] = [h]
                        push(queue, r)
                    else:
                        filed.append(h)
        live = np.array(sym, np.int64)
        kept = np.flatnonzero(live != -2)
        out = live[kept]
        cuts = np.flatnonzero(out == -1)
        whole = out.astype("<u4").tobytes()
        starts = np.concatenate([[0], cuts[:-1] + 1])
        return [whole[4 * s : 4 * e] for s, e in zip(starts.tolist(), cuts.tolist())]


class BlockEncoder:
    """Encodes blocks of texts; a memo of at most ``memo_size`` words is kept between blocks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_size: int = 700_000):
        import regex

        self.replay = MergeReplay(ranks)
        self.find: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.memo_size = memo_size

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        if len(self.memo) > self.memo_size:
            self.memo = {}
        memo = self.memo
        words = [self.find(t) for t in texts]
        fresh = list({w for own in words for w in own if w not in memo})
        memo.update(zip(fresh, self.replay.encode_words([w.encode("utf-8") for w in fresh])))
        for own in words:
            yield array("I", b"".join(map(memo.__getitem__, own))).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids))


_encoders: dict[tuple[str, str], BlockEncoder] = {}


def block_encoder(path: str, pattern: str) -> BlockEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BlockEncoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def forget(most: int = 200_000) -> None:
    """Empty the memos of more than ``most`` words: what a worker keeps between tasks is bounded."""
    for own in _encoders.values():
        if len(own.memo) > most:
            own.memo = {}


common.memos.append(forget)


def byte_bpe(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = block_encoder(vocabulary, pattern)
        shown = [str(i) for i in range(enc.replay.size)]
        for table in common.blocks(batches, chars=3_000_000):
            counts, ids_sha, decoded_sha, kept = [], [], [], []
            for ids in enc.encode(common.texts_of(table)):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            cols = [table.column("doc_id").combine_chunks(), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidied(run, forget, cycles=False), schema)
