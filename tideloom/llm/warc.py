"""WARC (operator 2): archives with an index that is written first and read by coalesced byte ranges.

Writing: every page becomes one gzip member in an archive, and one row (path, offset, length, url, digest)
in the index.  Of pages with equal payloads of ``least`` bytes or more, that with the smallest ``page_id``
is a ``response``; the others are ``revisit`` records without a payload.  Reading: index rows are brought together by archive,
sorted by offset, neighbouring ranges are joined into one read, and records are cut out of it.

Defined cases: null html is an empty payload; a null url leaves its header out; a null ``page_id`` is
written as such and never revisits; rows that repeat a ``page_id`` and payload are all responses if one of
them is the smallest; empty tables give no archive and no row; other columns are ignored.  Archives
carry the task attempt in their names and only committed index rows name them, so a repeated task
leaves no half-written archive in use.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SALTS = 64
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, path string, offset long, length long"


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """An uncompressed WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + CRLF + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of a record."""

    def fields(raw: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in raw.decode("utf-8").split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}

    head, _, rest = data.partition(CRLF + CRLF)
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    return warc, fields(http), payload


def deflate(data: bytes, level: int = 1) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _revisits(pages: DataFrame, least: int) -> DataFrame:
    """id and digest of the pages that revisit another one, with its id.  Moves digests, not payloads."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    seen = pages.select(F.col("page_id").cast("long").alias("id"), F.sha2(payload, 256).alias("sha"), F.octet_length(payload).alias("bytes")).filter((F.col("bytes") >= least) & F.col("id").isNotNull())
    # a payload of any number of pages is dealt to SALTS tasks, both when its first page is sought and when that is told
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = seen.groupBy("sha", "salt").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    groups = parts.groupBy("sha").agg(F.min("least").alias("refers_to"), F.max("most").alias("last"), F.collect_list("salt").alias("salts")).filter("refers_to < last")
    return seen.join(groups.select("sha", "refers_to", F.explode("salts").alias("salt")), ["sha", "salt"]).filter("id <> refers_to").select("id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = 100, archive_bytes: int = 16_000_000, level: int = 1, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``; returns the stored index."""
    revisits = common.stored(_revisits(pages, least), "warc-revisits")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}"
        n, out, offset = 0, None, 0
        try:
            for table in common.blocks(batches, "html"):
                rows: list[tuple] = []
                cols = (table.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))
                for page_id, url, html, refers_to in zip(*cols):
                    payload = (html or "").encode("utf-8")
                    digest = hashlib.sha256(payload).hexdigest()
                    member = deflate(record(page_id, url, payload, digest, refers_to, date), level)
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        path = f"{name}-{n:05d}.warc.gz"
                        out, n = common.open_out(path), n + 1
                        info = "software: tideloom\r\nformat: WARC File Format 1.1\r\n".encode()
                        lead = deflate(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{task.partitionId()}-{n}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + CRLF + CRLF)
                        out.write(lead)
                        offset = len(lead)
                    out.write(member)
                    rows.append((page_id, url, digest, "response" if refers_to is None else "revisit", path, offset, len(member)))
                    offset += len(member)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    marked = source.join(revisits, (F.col("page_id") == F.col("id")) & (F.sha2(F.coalesce("html", F.lit("")), 256) == F.col("sha")), "left")
    return common.stored(marked.select("page_id", "url", "html", "refers_to").mapInArrow(common.tidied(write), INDEX), "warc-index")


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) ranges joined over gaps of at most ``gap`` into reads of about ``most`` bytes: (start, end, members)."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        if reads and offset - reads[-1][1] <= gap and offset + length - reads[-1][0] <= most:
            start, end, members = reads[-1]
            members.append(i)
            reads[-1] = (start, max(end, offset + length), members)
        else:
            reads.append((offset, offset + length, [i]))
    return reads


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(selected: DataFrame, gap: int = 65_536, most: int = 4_000_000, with_payload: bool = False) -> DataFrame:
    """The records that the index rows ``selected`` name, read from the archives; their digests are checked."""

    def page_of(uri: str | None) -> int | None:
        text = (uri or "").removeprefix("<urn:x-page:").rstrip(">")
        return int(text) if text not in ("", "null") else None

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [*(x.split()[0] for x in RECORDS.split(", ")), "payload"]
        keep = 7 if with_payload else 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(zip(*rows), kinds))[:keep]], names=names[:keep])

    def of_archive(path: str, ranges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        with common.open_in(path) as f:
            for start, end, members in coalesce_ranges(ranges, gap, most):
                f.seek(start)
                data = f.read(end - start)
                rows = []
                for i in members:
                    at = ranges[i][0] - start
                    warc, http, payload = parse(zlib.decompress(data[at : at + ranges[i][1]], 31))
                    digest = warc["warc-payload-digest"].removeprefix("sha256:")
                    kind = warc["warc-type"]
                    size = int(http["content-length"])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{path}: the payload at {ranges[i][0]} does not match its digest")
                    rows.append((page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), size, digest, kind, page_of(warc.get("warc-refers-to")), payload))
                yield emit(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ranges = None, []
        for batch in batches:
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if path != now:
                    if ranges:
                        yield from of_archive(now, ranges)
                    now, ranges = path, []
                ranges.append((offset, length))
        if ranges:
            yield from of_archive(now, ranges)

    by_archive = selected.select("path", "offset", "length").repartition(F.col("path")).sortWithinPartitions("path", "offset")
    return by_archive.mapInArrow(common.tidied(run), RECORDS + ", payload binary" * with_payload)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive all pages and read every record back through the index."""
    index = write_archives(pages, folder or common.shared_dir(pages.sparkSession, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
