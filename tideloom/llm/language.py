"""Language identification (operator 6): rank-order n-gram profiles.

A profile lists the ``profile_size`` most frequent letter n-grams (one to three letters, a blank marking
word ends) of a language over all its training texts.  A text is compared by its own ``text_size`` most frequent
n-grams: each adds the distance of its rank from its rank in the profile, or ``profile_size`` if it is
missing there.  The nearest profile wins; the score is its relative lead over the second nearest.

Texts are counted whole.  Training counts are summed in each task, then by (language, n-gram), so
nothing grows with the number of texts; only the finished profiles (``profile_size`` rows for each language) reach the driver.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties of counts go to the n-gram
of lower code points, ties of distance to the first language by name; null languages are not learned;
with no training rows every text is ``und``; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common

#: Characters whose n-grams a worker holds at once.
BLOCK_CHARS = 1_000_000
UND = "und"
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """True at each code point that is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


class Block:
    """n-grams of the texts of a block, in codes that keep the order of code points."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        chars = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
        letter = letter_table()[chars]
        seen = np.zeros(0x110000, bool)
        seen[chars[letter]] = True
        self.alphabet = np.flatnonzero(seen)  # code 0 is the blank
        code = np.zeros(0x110000, np.uint32)
        code[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        self.code = code
        self.bits = max(1, int(len(self.alphabet)).bit_length())
        kind = np.uint32 if 3 * self.bits + 2 <= 32 else np.uint64
        blank = ~letter
        keep = np.ones(len(chars), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        starts = np.concatenate([[0], ends[:-1]])
        keep[starts[starts < len(keep)]] |= blank[starts[starts < len(keep)]]
        before = np.concatenate([[0], np.cumsum(keep)])
        self.bounds = before[np.concatenate([[0], ends])]
        self.codes = code[chars[keep]].astype(kind)  # what is no letter has code 0

    def grams(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted n-grams of text ``i`` and their counts."""
        c = self.codes[self.bounds[i] : self.bounds[i + 1]]
        c = np.concatenate([np.zeros(1, c.dtype), c]) if len(c) and c[0] else c
        b = c.dtype.type(self.bits)
        one = c[c > 0]
        pair = (c[:-1] << b) | c[1:]
        left, right = c[:-1] > 0, c[1:] > 0
        two = pair[left | right]  # a blank on one side only: "_x" and "x_"
        three = ((pair[:-1] << b) | c[2:])[right[:-1]] if len(c) > 2 else pair[:0]
        # the tag tells lengths apart: a pair that begins with a blank would equal a single letter
        keys = np.concatenate([self._tag(one, 1), self._tag(two, 2), self._tag(three, 3)])
        keys.sort()
        if not len(keys):
            return keys, np.zeros(0, np.int64)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[edge], np.diff(np.append(edge, len(keys)))

    def _tag(self, keys: np.ndarray, length: int) -> np.ndarray:
        two = keys.dtype.type(2)
        return (keys << two) | keys.dtype.type(length)

    def global_keys(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Length and three code points (0: blank) of block keys."""
        k = keys.astype(np.uint64)
        length = (k & np.uint64(3)).astype(np.int64)
        k >>= np.uint64(2)
        mask = np.uint64((1 << self.bits) - 1)
        points = np.concatenate([[0], self.alphabet])
        return length, *(points[((k >> np.uint64(s * self.bits)) & mask).astype(np.int64)] for s in (2, 1, 0))

    def block_keys(self, length: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Block keys of global n-grams (rows of three code points); those with letters that the block lacks get the highest key."""
        codes = self.code[points]
        known = ((codes > 0) | (points == 0)).all(axis=1)
        k = np.zeros(len(points), np.uint64)
        for s in range(3):
            k = (k << np.uint64(self.bits)) | codes[:, s].astype(np.uint64)
        k = (k << np.uint64(2)) | length.astype(np.uint64)
        k[~known] = np.uint64(2**64 - 1)
        return k


def _pack(length: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """n-grams as int64: three code points of 20 bits hold all letters but plane 16, and 2 bits of length."""
    return ((a << 42) | (b << 22) | (c << 2) | length).astype(np.int64)


def _unpack(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << 20) - 1
    return keys & 3, np.stack([(keys >> 42) & mask, (keys >> 22) & mask, (keys >> 2) & mask], axis=1)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: counts of each task's texts (lang, text), to be summed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for table in common.blocks(batches, chars=BLOCK_CHARS):
            langs = table.column("lang").to_pylist()
            block = Block(common.texts_of(table))
            parts: dict[str, list] = {}
            for i, lang in enumerate(langs):
                parts.setdefault(lang, []).append(block.grams(i))
            for lang, found in parts.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)
                own = sums.setdefault(lang, {})
                for key, count in zip(_pack(*block.global_keys(keys)).tolist(), n.tolist()):
                    own[key] = own.get(key, 0) + count
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidied(run), "lang string, gram long, n long")


def fit_profiles(docs: DataFrame, profile_size: int = 400) -> dict[str, list[int]]:
    """The n-grams of each language, most frequent first, learned from all rows with a text and a ``lang``."""
    sums = gram_counts(docs.filter("text is not null and lang is not null")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("rank", rank).filter(F.col("rank") <= profile_size).orderBy("lang", "rank")
    out: dict[str, list[int]] = {}
    for row in top.collect():  # profile_size rows for each language
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


class Judge:
    """Out-of-place distances of texts to the profiles."""

    def __init__(self, profiles: dict[str, list[int]], text_size: int, profile_size: int):
        self.names = sorted(profiles)
        self.text_size, self.profile_size = text_size, profile_size
        grams = np.array(sorted({g for own in profiles.values() for g in own}), np.int64)
        where = {g: i for i, g in enumerate(grams.tolist())}
        self.ranks = np.full((len(grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            for rank, gram in enumerate(profiles[name]):
                self.ranks[where[gram], k] = rank
        self.length, self.points = _unpack(grams)

    def judge(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        block = Block(texts)
        keys = block.block_keys(self.length, self.points)
        order = np.argsort(keys, kind="stable")
        known = keys[order]
        for i in range(len(texts)):
            grams, counts = block.grams(i)
            if not len(grams) or not self.names:
                yield UND, 0.0
                continue
            n = len(grams)
            shift = np.int64(n.bit_length())
            by = ((counts.max() - counts) << shift) | np.arange(n)
            if n > self.text_size:
                by = np.partition(by, self.text_size - 1)[: self.text_size]
            by.sort()
            mine = grams[by & ((np.int64(1) << shift) - 1)].astype(np.uint64)
            at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
            hit = known[at] == mine
            ranks = self.ranks[np.where(hit, order[at], len(self.ranks) - 1)]
            far = np.where(ranks < 0, self.profile_size, np.minimum(np.abs(ranks - np.arange(len(mine))[:, None]), self.profile_size)).sum(axis=0)
            best = int(far.argmin())
            if len(far) == 1:
                lead = 1 - far[0] / (self.profile_size * len(mine))
            else:
                second = np.delete(far, best).min()
                lead = (second - far[best]) / second if second else 0.0
            yield self.names[best], float(lead)


def identify(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str] | None = None, text_size: int = 300, profile_size: int = 400, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id (or the columns ``keep``), and under ``names`` the language and the score of every row, by its whole text alone."""
    keep = keep or ["doc_id"]
    own = "text" if "text" in keep and docs.schema["text"].dataType == StringType() else None  # one copy of the texts is enough
    column = own or common.fresh(docs, "whole_text")[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, text_size, profile_size)
        for table in common.blocks(batches, column, BLOCK_CHARS):
            found = list(judge.judge(common.texts_of(table, column)))
            if not own:
                table = table.drop_columns([column])
            table = table.append_column(names[0], pa.array([f[0] for f in found], pa.string())).append_column(names[1], pa.array([f[1] for f in found], pa.float64()))
            yield from table.to_batches()

    kept = [F.col(f"`{c}`") for c in keep]
    source = docs.select(*kept) if own else docs.select(*kept, F.col("text").cast("string").alias(column))
    schema = StructType([*(f for f in source.schema.fields if f.name != column or own), StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return source.mapInArrow(common.tidied(run), schema)


def held_out(doc_id: str = "doc_id"):
    """True for the rows that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def language_id(docs: DataFrame, profile_size: int = 400, text_size: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learn from the rows that are not held out, then judge every row."""
    marked = docs.select("doc_id", held_out().alias("held_out"), "lang", "text")
    profiles = fit_profiles(marked.filter("not held_out"), profile_size)
    return identify(marked, profiles, ["doc_id", "held_out"], text_size, profile_size)


def keep_identified(docs: DataFrame, least_score: float = 0.02, profile_size: int = 400, text_size: int = 300) -> DataFrame:
    """The rows whose language is told with a score of at least ``least_score``, with all their columns, whatever their names."""
    profiles = fit_profiles(docs.filter(~held_out()), profile_size)
    names = tuple(common.fresh(docs, "lang_pred", "score"))
    judged = identify(docs, profiles, docs.columns, text_size, profile_size, names)
    kept = judged.filter((F.col(names[0]) != UND) & (F.col(names[1]) >= least_score))
    return kept.drop(*names)
