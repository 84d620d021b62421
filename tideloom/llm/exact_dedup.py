"""Exact dedup (operator 1): content-defined chunk recipes.

Each text, as UTF-8 bytes, is cut where a gear hash of the last 32 bytes has ``mask_bits`` zero bits, so
equal texts are cut alike wherever they lie.  A chunk's identifier is its 64-bit fingerprint, verified
against the chunk's SHA-256: a fingerprint that two contents share gets an ordinal per content.  Texts are
equal when their ordered identifier lists are; only identifiers and digests move, long texts never do.

Defined cases: a null text counts as empty; all empty texts are equal; a null ``doc_id`` sorts below all
others; of rows that repeat a ``doc_id`` and text exactly one stays; an empty table gives an empty
table; other columns of the input, whatever their names, are ignored by :func:`exact_dedup` and returned
unchanged by :func:`keep_first`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 32
#: Tasks among which the rows of one group of copies are dealt.
SALTS = 64
_GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there, by doubling the window five times."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        more = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += more
    return h


def cut_points(data: bytes, bounds: list[int], mask_bits: int, least: int, most: int) -> list[list[int]]:
    """Ends of the chunks of each text; ``bounds`` are the ends of the texts in ``data``."""
    mask = np.uint32(((1 << mask_bits) - 1) << (32 - mask_bits))
    marks = (np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) & mask == 0) + 1) if data else np.zeros(0, np.int64)
    out, start = [], 0
    firsts = np.searchsorted(marks, [0, *bounds[:-1]]).tolist() if bounds else []
    lasts = np.searchsorted(marks, bounds).tolist() if bounds else []
    for end, a, b in zip(bounds, firsts, lasts):
        cuts, at = [], start
        for m in [*marks[a:b].tolist(), end]:
            while m - at > most:
                at += most
                cuts.append(at)
            if m - at >= least or m == end and m > at:
                at = m
                cuts.append(m)
        out.append(cuts)
        start = end
    return out


def recipes(docs: DataFrame, mask_bits: int = 12, least: int = 1024, most: int = 32768, fingerprint_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and chunks (fp, d0..d3: the SHA-256 as four longs) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = (1 << fingerprint_bits) - 1
        for table in common.blocks(batches):
            raw = [t.encode("utf-8") for t in common.texts_of(table)]
            bounds = np.cumsum([len(r) for r in raw]).tolist()
            data = b"".join(raw)
            offsets, fps, digests, whole, start = [0], [], [], [], 0
            for text, cuts, end in zip(raw, cut_points(data, bounds, mask_bits, least, most), bounds):
                whole.append(digest := hashlib.sha256(text))
                for at in cuts:
                    chunk = data[start:at]
                    fps.append(xxhash.xxh64_intdigest(chunk) & keep)
                    digests.append(digest.digest() if len(cuts) == 1 else hashlib.sha256(chunk).digest())
                    start = at
                start = end
                offsets.append(len(fps))
            words = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 4)
            cols = [pa.array(np.array(fps, np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(4))]
            chunks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cols, names=["fp", "d0", "d1", "d2", "d3"]))
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array([d.hexdigest() for d in whole]), chunks], names=["doc_id", "text_sha256", "chunks"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(common.tidied(run), "doc_id long, text_sha256 string, chunks array<struct<fp:long,d0:long,d1:long,d2:long,d3:long>>")


def _collided(made: DataFrame) -> DataFrame:
    """Fingerprints that stand for more than one content; sums up before the shuffle."""
    parts = [f"d{k}" for k in range(4)]
    agg = [f(p).alias(f"{n}_{p}") for p in parts for n, f in (("lo", F.min), ("hi", F.max))]
    found = made.select(F.explode("chunks").alias("c")).select("c.*").groupBy("fp").agg(*agg)
    return found.filter(" or ".join(f"lo_{p} <> hi_{p}" for p in parts)).select("fp")


def identified(made: DataFrame) -> DataFrame:
    """The stored recipes with ``recipe``: the ordered verified identifiers of each row's chunks."""
    collided = common.stored(_collided(made), "dedup-collided")
    if collided.isEmpty():
        return made.withColumn("recipe", F.transform("chunks", lambda c: c["fp"]))
    contents = made.select(F.explode("chunks").alias("c")).select("c.*").join(collided, "fp").distinct()
    from pyspark.sql import Window

    ordinals = contents.withColumn("ordinal", F.row_number().over(Window.partitionBy("fp").orderBy("d0", "d1", "d2", "d3")).cast("long"))
    placed = made.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", "c.*")
    keys = ["fp", "d0", "d1", "d2", "d3"]
    known = placed.join(ordinals, keys, "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "fp", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))).alias("ids"))
    lists = known.select("row", F.flatten(F.transform("ids", lambda c: F.array(c["fp"], c["ordinal"]))).alias("recipe"))
    return made.join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<long>")))


def exact_dedup(docs: DataFrame, **chunking: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row; the largest ``doc_id`` stays."""
    made = common.stored(recipes(docs, **chunking).withColumn("row", F.monotonically_increasing_id()), "dedup-recipes")
    rows = identified(made).select("doc_id", "row", "text_sha256", "recipe").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    # a group of any size is dealt to SALTS tasks, both when it is summed up and when it is told its sum
    parts = rows.groupBy("recipe", "salt").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    groups = parts.groupBy("recipe").agg(F.max("keep").alias("keep"), F.sum("group_size").alias("group_size"), F.collect_list("salt").alias("salts"))
    joined = rows.join(groups.select("recipe", "keep", "group_size", F.explode("salts").alias("salt")), ["recipe", "salt"])
    return joined.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, **chunking: int) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns."""
    found = common.stored(exact_dedup(docs, **chunking).select("doc_id", "text_sha256", "kept"), "dedup-decisions")
    own, kept_id, kept_digest = common.fresh(docs, "own_digest", "kept_id", "kept_digest")
    kept = found.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_digest))
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    left = docs.withColumn(own, digest).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_digest)), "left_semi")
    if not found.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)
