"""Shared helpers of the corpus operators: blocks of documents, shared folders and byte stores.

Executors and the driver share only the folder named by ``spark.checkpoint.dir``; every table or file
that one job leaves for another is written there.  Files are opened through :func:`open_out` and
:func:`open_in`, which use the local file system for ``file:`` and plain paths (a shared mount) and
``pyarrow.fs`` for any other store.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text (code points, as a cheap bound) that a Python worker handles at once.
BLOCK_CHARS = 4_000_000


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a temporary one is set where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tideloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def open_out(path: str):
    """A binary file for writing at a local path, a ``file:`` URI or any URI that pyarrow knows."""
    local = _local(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner)


def open_in(path: str):
    """A seekable binary file for reading; the counterpart of :func:`open_out`."""
    local = _local(path)
    if local:
        return open(local, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def write_file(path: str, content: bytes) -> None:
    """Write a whole file; on a file system a reader meets all of it or nothing, also when two attempts of a task write it."""
    local = _local(path)
    if not local:
        with open_out(path) as f:
            f.write(content)
        return
    os.makedirs(os.path.dirname(local), exist_ok=True)
    draft = f"{local}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(content)
    os.replace(draft, local)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have, one for each of ``names``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def replayable(df: DataFrame, tag: str) -> DataFrame:
    """``df`` itself where it only scans files, so that every reading gives the same rows in the same order; else stored first."""
    kinds = {line.lstrip(" +-:").split(" ")[0].split("(")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip()}
    return df if kinds <= {"Project", "Relation", "RelationV2", "LogicalRelation"} else stored(df, tag)


#: Functions that empty the memos of encoders which outlive a task.
memos: list[Callable[[int], None]] = []


def tidied(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None, cycles: bool = True, keeps: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which serves other tasks too, calls ``forget`` and gives its free memory back.

    ``keeps`` True: the memos of ``run`` serve its next tasks in the worker; the first task of any other kind empties them.
    ``cycles`` False: ``run`` makes no cycles, and the collector rests while it works.
    """

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if not keeps and not forget:
                for empty in memos:
                    empty(0)
            if not cycles:
                gc.disable()
            yield from run(batches)
        finally:
            if forget:
                forget()
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return whole


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins, with the end; null counts as empty."""
    array = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if array.null_count:
        array = pc.fill_null(array, "")
    array = array.cast(pa.binary()).cast(pa.large_binary())
    places = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
    return data, places - places[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[pa.Table]:
    """Cut or join Arrow batches into tables whose ``text`` column has about ``chars`` bytes at most.

    A single longer text forms a table of its own, so memory is bounded by the longest text.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if size + n > chars and (size or i > start):
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def texts_of(table: pa.Table, text: str = "text") -> list[str]:
    """The texts of a block; null counts as empty."""
    return [t or "" for t in table.column(text).to_pylist()]


def marked(df: DataFrame, column: str, most_bits: int = 1 << 26) -> np.ndarray:
    """A bit map of hashes of a column of longs, as 64-bit words; at most ``most_bits`` bits reach the driver, whatever the table's size."""
    bits = 1 << 16
    n = df.count()
    while bits < min(most_bits, 16 * n):
        bits *= 2
    placed = df.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("place")).selectExpr("place >> 6 as word", "1L << cast(place & 63 as int) as bit")
    words = placed.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Let Arrow batches have at most ``rows`` rows, as a batch of whole texts lies in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    return spark


def likely(df: DataFrame, column: str, bitmap: np.ndarray) -> DataFrame:
    """The rows whose column is in the bit map, and few others: so that a join with a small side need not move all texts."""
    bits = len(bitmap) * 64
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy()
            hit = (words[place >> 6] >> (place & 63)) & 1
            kept = batch.filter(pa.array(hit.astype(bool)))
            if kept.num_rows:
                yield kept

    (name,) = fresh(df, "place")
    placed = df.withColumn(name, F.pmod(F.xxhash64(column), F.lit(bits)))
    return placed.mapInArrow(tidied(run), placed.schema).drop(name)
