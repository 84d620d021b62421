"""Token ids of a lower-casing word-BPE vocabulary by the ``tokenizers`` library, with a bounded memo.

The vocabulary drops white space, and none of its pre-tokens crosses a blank or a line feed, so the
ids of a text are the ids of its blank-separated chunks, one after the other.  Each distinct chunk is
encoded once by the library; the memo is emptied when it holds ``memo_size`` chunks.  Chunks of Latin-1
letters, with at most one full stop or comma after them, go straight to the library's BPE model: they
are single pre-tokens that NFC leaves alone.  All other chunks pass the library's whole chain, which also finds the
strings of special tokens, as in whole texts.  A vocabulary with an added token that holds white space or takes notice of
its surroundings has its texts encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class WordBpe:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers in a ``bytes`` object."""

    def __init__(self, path: str, memo_size: int = 900_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = json.loads(self.tok.to_str()).get("added_tokens", [])
        self.chunked = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(map(str.isspace, t["content"])) for t in added)
        self.model = self.tok.model
        self.letters = byte_letters()
        self.memo: dict[str, bytes] = {"": b""}
        self.memo_size = memo_size

    def _word(self, word: str) -> bytes:
        mapped = "".join(map(self.letters.__getitem__, word.lower().encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _learn(self, chunk: str) -> bytes:
        if chunk <= "\xff" * len(chunk) and max(chunk) <= "\xff":
            core = chunk[:-1] if chunk[-1] in ".," else chunk
            if core.isalpha():
                lower = core.lower()
                ids = self.memo.get(lower)
                if ids is None:
                    ids = self.memo[lower] = self._word(core)
                if core is not chunk:
                    ids += self.memo.get(chunk[-1]) or self._full(chunk[-1])
                return ids
        return self._full(chunk)

    def _full(self, chunk: str) -> bytes:
        return array("I", self.tok.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.chunked:
            return self._full(text)
        memo = self.memo
        out = []
        for chunk in text.replace("\n", " ").split(" "):
            ids = memo.get(chunk)
            if ids is None:
                if len(memo) > self.memo_size:
                    memo.clear()
                    memo[""] = b""
                ids = self._learn(chunk)
                if len(chunk) < 64:
                    memo[chunk] = ids
            out.append(ids)
        return b"".join(out)


_encoders: dict[tuple[str, int], WordBpe] = {}


def encoder(path: str, memo_size: int = 900_000) -> WordBpe:
    """One encoder for each vocabulary and worker process.  A memo entry takes about 250 bytes."""
    if (path, memo_size) not in _encoders:
        _encoders[path, memo_size] = WordBpe(path, memo_size)
    return _encoders[path, memo_size]


def forget(most: int = 200_000) -> None:
    """Empty the memos of more than ``most`` chunks: what a worker keeps between tasks stays under 50 MB."""
    for own in _encoders.values():
        if len(own.memo) > most:
            own.memo = {"": b""}


common.memos.append(forget)
