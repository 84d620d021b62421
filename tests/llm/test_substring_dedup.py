"""Induced suffix order against sorting, and repeat removal against a table of all windows."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tideloom.llm.induced import Store, suffix_order
from tideloom.llm.substring_dedup import NO_ID, _judged, _packed, _sides, merge, parcels, remove_repeats, repeats, segments


def sorted_suffixes(text, cap):
    text = list(text)
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0] * len(text)
    for k in range(1, len(text)):
        a, b = text[order[k - 1] :], text[order[k] :]
        n = 0
        while n < min(cap, len(a), len(b)) and a[n] == b[n]:
            n += 1
        shared[k] = n
    return order, shared


@pytest.mark.parametrize("in_memory", [0, 4, 10**6])
def test_suffix_order(in_memory):
    rng = np.random.default_rng(3)
    for trial in range(120):
        text = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 70))).astype(np.int32)
        if trial % 3 == 0:
            text = np.concatenate([text, text, text[: len(text) // 2]])
        order, shared = suffix_order(text, 50, in_memory=in_memory)
        assert (order.tolist(), shared.tolist()) == sorted_suffixes(text, 50)


def test_suffix_order_with_queues_in_files_and_recursion():
    rng = np.random.default_rng(5)
    piece = rng.integers(0, 4, 3000)
    text = np.concatenate([rng.integers(0, 4, 4000), piece, rng.integers(0, 4, 500), piece, piece[100:2000]]).astype(np.uint8)
    with Store(least=1) as store:
        order, shared = suffix_order(text, 50, store, in_memory=50)
        assert store.n_files >= 9  # three arrays of each of three levels of the recursion, or more
        assert (np.asarray(order).tolist(), np.asarray(shared).tolist()) == sorted_suffixes(text.tolist(), 50)


def test_merge():
    assert merge(np.array([[0, 5], [3, 4], [5, 9], [12, 14]])).tolist() == [[0, 9], [12, 14]]


def brute(rows, least=50):
    smallest = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - least + 1):
            w = raw[i : i + least]
            smallest[w] = min(smallest.get(w, d), d)
    out = {}
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            if smallest[raw[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    # many parcels and shards, all queues in files
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats(docs, parcel_bytes=300_000, side_hashes=50_000, shard_bytes=200_000, queue_bytes=1).collect()}
    assert found == brute(rows)


def test_long_text_in_stretches(spark):
    rng = np.random.default_rng(7)
    long = "".join(map(chr, rng.integers(97, 123, 2_500_000)))
    rows = [(1, "x" * 30 + long[262_100:262_300] + "y" * 30), (2, long), (3, long[2_499_900:] + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats(docs, parcel_bytes=1000).collect()}
    assert found == {1: (0, 0), 2: (200, 1), 3: (100, 1)}


def test_odd_rows(spark):
    a, b = "".join(chr(97 + i * 7 % 26) for i in range(30)) + "é" * 40, "".join(chr(48 + i * i % 75) for i in range(60))
    rows = [(1, None, "x"), (2, "", "x"), (3, a, None), (4, "zz" + a + "yy", "x"), (5, b * 3, "x"), (5, b * 3, "x"), (None, b, "x"), (7, "q" * 30_000, "x"), (8, "q" * 200, "x"), (9, a[:49], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in repeats(docs).collect()}
    assert out == {(1, 0): (0, 0), (2, 0): (0, 0), (3, 110): (0, 0), (4, 114): (110, 1), (5, 180): (0, 0), (None, 60): (60, 1), (7, 30_000): (0, 0), (8, 200): (200, 1), (9, 68): (68, 1)}
    assert repeats(docs.limit(0)).count() == 0
    cut = remove_repeats(docs)
    assert cut.columns == docs.columns
    texts = {(r["doc_id"], r["text"]) for r in cut.collect()}
    assert (1, None) in texts and (4, "zzyy") in texts and (8, "") in texts and (5, b * 3) in texts


def test_columns_of_any_name(spark):
    a = "".join(chr(97 + i * 7 % 26) for i in range(30)) * 2
    rows = [(1, a, 1, "p", [1], 0.5), (2, "b" + a, 2, "q", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, __id string, spans array<int>, parcel double")
    cut = remove_repeats(docs)
    assert cut.schema == docs.schema
    assert sorted(map(tuple, cut.collect())) == [rows[0], (2, "b", 2, "q", None, None)]


def test_input_that_is_no_scan_is_stored_first(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dealt = docs.repartition(7).filter("doc_id % 3 > 0")
    rows = [(r["doc_id"], r["text"]) for r in dealt.select("doc_id", "text").collect()]
    found = {r["doc_id"]: tuple(r)[1:] for r in repeats(dealt, parcel_bytes=100_000).collect()}
    assert found == brute(rows)


def peak_of(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_shard():
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, 6, dtype=np.uint8)) + b" " for _ in range(3000)]
    bodies = [b"".join(words[k] for k in rng.integers(0, 3000, 12)) for _ in range(12_000)]
    ids = np.arange(len(bodies)) + 5
    ids[-1] = NO_ID
    one = _packed(len(bodies).to_bytes(4, "little") + ids.astype("<i8").tobytes() + np.fromiter(map(len, bodies), "<u2").tobytes() + b"".join(bodies))
    two = _packed((1).to_bytes(4, "little") + np.array([7], "<i8").tobytes() + np.array([84], "<u2").tobytes() + bodies[0])
    told, peak = peak_of(lambda: _judged([one, two], 50, 1))
    assert told[0] is None and told[1] is not None  # of the first parcel no content is repeated at a smaller id
    assert peak < 40 * sum(map(len, bodies))


def test_memory_of_a_parcel():
    rng = np.random.default_rng(12)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], names=["id", "text"])
    (parcel,) = parcels([batch], "id", "text", 8_000_000)
    (value, _, numbers), peak = peak_of(lambda: _sides(parcel, segments(parcel.data, parcel.bounds, 50), 3))
    assert len(value) == max(n.max() for n in numbers) + 1
    assert peak < 7 * len(parcel.data)
