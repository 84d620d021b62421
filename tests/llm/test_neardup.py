"""Near-dedup against brute force over the true shingle sets."""

import re

import pytest

from tideloom.llm.neardup import keep_one, near_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if group[i] == group[j] or not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (d, _) in zip(group, sets):
        least[g] = min(least.get(g, d), d)
    return {d: (len(s), least[g]) for g, (d, s) in zip(group, sets)}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_whole_small_table(spark, size, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(docs, size=size, percent=percent).collect()}
    assert found == brute(rows, size, percent)


def test_small_blocks_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(100_000 + i, "one two three four five six seven eight nine ten eleven twelve thirteen " + "x" * (i % 3)) for i in range(60)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    whole = near_dedup(docs, size=3, percent=85).orderBy("doc_id").collect()
    assert near_dedup(docs, size=3, percent=85, leaf=2, node_block=7, family_block=5).orderBy("doc_id").collect() == whole


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "one two", "b"), (5, "ONE  two", None), (6, text, "c"), (6, text, "c"), (None, text, "d"), (8, text + " w40", "e"), (9, "x " * 50_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dedup(docs, size=5, percent=80).collect()}
    assert out == {(1, 0): 1, (2, 0): 2, (3, 0): 3, (4, 1): 4, (5, 1): 4, (6, 36): 6, (None, 36): 6, (8, 37): 6, (9, 1): 9}
    assert near_dedup(docs.limit(0)).count() == 0
    kept = keep_one(docs.filter("doc_id is not null"), size=5, percent=80)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 9]
