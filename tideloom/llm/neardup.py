"""MinHash near-dedup (operator 7): a chosen-path set similarity join.

Each text is the set of its distinct word shingles.  Equal sets form one class with one representative, so copies
never multiply.  Representatives have ``n_tokens`` minwise tokens.  In each of ``n_trees`` independent trees a node
branches its documents by the value of the token chosen for that tree and level; nodes of at most ``leaf`` members,
and those at the last level, are compared exhaustively by their tokens.  Pairs of enough agreement form
families; families get their full sets, and links are confirmed on these.  The classes of a linked component
share its smallest ``doc_id``.

Two sets of similarity s stay together in one level with probability s.  The number of trees follows from the threshold, the
levels and ``miss``: where every node branches to the fourth level, 10 trees miss a pair at 0.85 with a chance of 6e-4
and 14 trees one at 0.8 with 6e-4; trees share no token.  Nodes that are small sooner miss less (6e-9 and 2e-10 at one
level).  Agreement of at least ``agree`` of 64 tokens keeps all but 5e-5 of the pairs at the threshold.

Large groups: a node or family of more than ``block`` members is cut in blocks, and every pair of blocks is
compared in a task of its own, so memory is bounded and no pair is left out.  Within a task only a spanning
forest of the links leaves it, never all pairs.

Defined cases: a text without words (or null) has an empty set, links with nothing and is its own
component; a text of fewer words than a shingle has one shingle; rows that repeat a ``doc_id`` share a component
if their sets are linked, and of the rows with the smallest id one is kept; a null ``doc_id`` sorts last and names a
component only if all its members are null; an empty table gives an empty table; other columns are ignored, or
returned unchanged by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components
from .shingles import mix, shingle_sets

N_TOKENS = 64
#: Tasks among which the members of one node or family are dealt.
SALTS = 64
_MULTIPLIERS = np.random.default_rng(17).integers(0, 1 << 63, N_TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set of shingle hashes."""
    best = np.full(N_TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 512):
        values = ((shingles[at : at + 512, None] * _MULTIPLIERS) >> np.uint64(32)).astype(np.uint32)
        np.minimum(best, values.min(axis=0), out=best)
    return best


def trees_for(percent: int, levels: int, miss: float) -> int:
    """Trees that part a pair at the threshold in all of them with a chance of ``miss`` at most, if every tree goes to its last level."""
    together = (percent / 100) ** levels
    n_trees = math.ceil(math.log(miss) / math.log(1 - together))
    if n_trees * levels > N_TOKENS:
        raise ValueError(f"{n_trees} trees of {levels} levels need more than {N_TOKENS} tokens")
    return n_trees


def tree_paths(tokens: np.ndarray, n_trees: int, levels: int) -> np.ndarray:
    """For each row of tokens the node of every tree and level, as a hash of the tokens chosen down to it; no two trees share a token."""
    chosen = np.random.default_rng(23).permutation(N_TOKENS)[: n_trees * levels].reshape(n_trees, levels)
    out = np.empty((len(tokens), n_trees, levels), np.uint64)
    for tree in range(n_trees):
        node = np.full(len(tokens), tree + 1, np.uint64)
        for level, token in enumerate(chosen[tree]):
            node = mix(mix(node + np.uint64(0x9E3779B97F4A7C15)) ^ tokens[:, token].astype(np.uint64))
            out[:, tree, level] = node
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int, n_trees: int, levels: int) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, set_a, set_b (a 128-bit digest of the set), tokens (binary) and nodes of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for table in common.blocks(batches):
            sets = shingle_sets(common.texts_of(table), size)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
            tokens = np.stack([minwise(s) for s in sets])
            nodes = tree_paths(tokens, n_trees, levels).reshape(len(sets), -1)
            flat = pa.array(nodes.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").combine_chunks(),
                    table.column("key").combine_chunks(),
                    pa.array(np.fromiter(map(len, sets), np.int64, len(sets))),
                    pa.array(np.ascontiguousarray(digests[:, 0])),
                    pa.array(np.ascontiguousarray(digests[:, 1])),
                    pa.array([t.tobytes() for t in tokens], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * nodes.shape[1]), flat),
                ],
                names=["doc_id", "key", "n_shingles", "set_a", "set_b", "tokens", "nodes"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return source.mapInArrow(common.tidied(run), "doc_id long, key long, n_shingles long, set_a long, set_b long, tokens binary, nodes array<long>")


def sized(members: DataFrame, key: str, **sums: str) -> DataFrame:
    """``members`` (key, member, ...) of keys with two members or more, with ``size`` and the sum of each column of ``sums`` by its name.

    The members of a key are dealt to ``SALTS`` tasks, both when they are counted and when they are told the count.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)))
    parts = salted.groupBy(key, "salt").agg(F.count("*").alias("size"), *(F.sum(c).alias(n) for n, c in sums.items()))
    totals = parts.groupBy(key).agg(F.sum("size").alias("size"), *(F.sum(n).alias(n) for n in sums), F.collect_list("salt").alias("salts")).filter("size > 1")
    return salted.join(totals.withColumn("salt", F.explode("salts")).drop("salts"), [key, "salt"]).drop("salt")


def blocked(members: DataFrame, key: str, block: int, weight: str | None = None, block_weight: int = 0) -> DataFrame:
    """``members`` (key, member, ...) with ``task``: one per key, or one per pair of blocks of a large key.

    Blocks have about ``block`` members at most, and members of about ``block_weight`` by the column ``weight``.  A member of a
    key of n blocks goes to n tasks; with one block, to one.
    """
    counted = sized(members, key, **({"total": weight} if weight else {}))
    n_blocks = F.ceil(F.col("size") / block)
    if weight:
        n_blocks = F.greatest(n_blocks, F.least(F.ceil(F.col("total") / block_weight), F.col("size")))
    dealt = counted.withColumn("n_blocks", n_blocks.cast("int"))
    own = F.pmod(F.xxhash64("member"), F.col("n_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda other: F.struct(F.least(own, other).alias("x"), F.greatest(own, other).alias("y")))
    dealt = dealt.withColumn("pair", F.explode(pairs))
    return dealt.withColumn("task", F.xxhash64(key, "pair.x", "pair.y")).select(*members.columns, "task")


def forest(n: int, rows_like: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among n items; ``rows_like(i, others)`` tells which of ``others`` link with i.

    Links inside what is joined already are not asked for again; the result is exact.
    """
    group = np.arange(n)
    found: list[tuple[int, int]] = []
    for i in range(n):
        others = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if not len(others):
            continue
        for j in others[rows_like(i, others)].tolist():
            if group[j] != group[i]:
                found.append((i, j))
                group[group == group[j]] = group[i]
    return found


def _runs(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, ...]]:
    """The rows of each task (its first column), which lie together, as lists of the other columns."""
    now, held = None, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in columns]
        for row in zip(*cols):
            if row[0] != now:
                if held:
                    yield held
                now, held = row[0], tuple([] for _ in columns[1:])
            for own, value in zip(held, row[1:]):
                own.append(value)
    if held:
        yield held


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def leaves(rows: DataFrame, leaf: int, levels: int) -> DataFrame:
    """node, member: each representative's leaf in every tree, for leaves of two members or more.

    ``rows`` has member and n1..n<levels>; a node of more than ``leaf`` members branches, until the last level.
    """
    out, left = None, rows
    for level in range(1, levels + 1):
        key = f"n{level}"
        counted = common.stored(sized(left, key), f"neardup-level-{level}")
        small = counted if level == levels else counted.filter(F.col("size") <= leaf)
        small = small.select(F.col(key).alias("node"), "member")
        out = small if out is None else out.unionByName(small)
        left = counted.filter(F.col("size") > leaf).drop("size", key)
        if level < levels and left.isEmpty():
            break
    return out.distinct()


def similar_by_tokens(members: DataFrame, agree: int) -> DataFrame:
    """Spanning forest edges (a, b) of the token agreement in each task; ``members``: task, member, tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for ids, raw in _runs(batches, ["task", "member", "tokens"]):
            tokens = np.frombuffer(b"".join(raw), np.uint32).reshape(len(ids), N_TOKENS)
            links = forest(len(ids), lambda i, others: np.count_nonzero(tokens[others] == tokens[i], axis=1) >= agree)
            pairs += [(ids[i], ids[j]) for i, j in links]
            if len(pairs) > 20_000:
                yield _edges(pairs)
                pairs = []
        if pairs:
            yield _edges(pairs)

    ordered = members.select("task", "member", "tokens").repartition(F.col("task")).sortWithinPartitions("task", "member")
    return ordered.mapInArrow(common.tidied(run), "a long, b long").distinct()


def confirmed(members: DataFrame, size: int, percent: int, agree: int) -> DataFrame:
    """Spanning forest edges of the confirmed links in each task; ``members``: task, member, text.

    100 * intersection >= percent * union, counted on the full sets.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _set_runs(batches, size):
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            tokens = np.stack([minwise(s) for s in sets])

            def linked(i: int, others: np.ndarray) -> np.ndarray:
                near = np.count_nonzero(tokens[others] == tokens[i], axis=1) >= agree
                near &= 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
                for k in np.flatnonzero(near).tolist():
                    j = int(others[k])
                    both = np.concatenate([sets[i], sets[j]])
                    both.sort()
                    common_size = int(np.count_nonzero(both[1:] == both[:-1]))
                    near[k] = 100 * common_size >= percent * (len(both) - common_size)
                return near

            pairs = [(ids[i], ids[j]) for i, j in forest(len(ids), linked)]
            if pairs:
                yield _edges(pairs)

    ordered = members.select("task", "member", "text").repartition(F.col("task")).sortWithinPartitions("task", "member")
    return ordered.mapInArrow(common.tidied(run), "a long, b long").distinct()


def _set_runs(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The members of each task, which lie together, with their shingle sets; texts are held for a few megabytes only."""
    now, ids, sets, texts, held = None, [], [], [], 0
    for batch in batches:
        for task, member, text in zip(*(batch.column(c).to_pylist() for c in ("task", "member", "text"))):
            if task != now or held > 2_000_000:
                sets += shingle_sets(texts, size)
                texts, held = [], 0
            if task != now:
                if ids:
                    yield ids, sets
                now, ids, sets = task, [], []
            ids.append(member)
            texts.append(text)
            held += len(text)
    if ids:
        yield ids, sets + shingle_sets(texts, size)


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, levels: int = 4, miss: float = 1e-3, leaf: int = 100, agree: int = 0, node_block: int = 20_000, family_block: int = 2_000, block_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and key (a hash of the text) of every row.

    ``miss``: chance that a pair at the threshold is in no common node at the last level; it gives the number of trees.
    ``node_block``: members of a node that are compared in a task, ``family_block`` and ``block_shingles`` the same of a family.
    ``agree``: least number of equal tokens of a candidate pair; 0 takes the threshold's expectation less
    four and a half standard deviations.
    """
    if not agree:
        p = percent / 100
        agree = int(N_TOKENS * p - 4.5 * (N_TOKENS * p * (1 - p)) ** 0.5)
    n_trees = trees_for(percent, levels, miss)
    made = common.stored(signatures(docs, size, n_trees, levels).withColumn("row", F.monotonically_increasing_id()), "neardup-signatures")
    # one row of each set stands for it: that of the smallest id
    least_id = F.coalesce("doc_id", F.lit(2**63 - 1))
    first = made.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(F.struct(least_id.alias("id"), "row")).alias("first"))
    classes = common.stored(first.select("set_a", "set_b", F.col("first.row").alias("member"), F.col("first.id").alias("least")), "neardup-classes")
    tokens = made.select(F.col("row").alias("member"), "tokens", "nodes").join(classes.select("member"), "member")
    trees = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.slice("nodes", t * levels + 1, levels)))
    rows = tokens.select("member", trees.alias("tree", "path")).select("member", *(F.col("path")[k].alias(f"n{k + 1}") for k in range(levels)))
    at_leaves = leaves(rows, leaf, levels)
    with_tokens = blocked(at_leaves, "node", node_block).join(made.select(F.col("row").alias("member"), "tokens"), "member")
    families = components(similar_by_tokens(with_tokens, agree), "neardup-families")
    # full texts of family members only
    members = families.select(F.col("node").alias("member"), F.col("component").alias("family"))
    placed = members.join(made.select(F.col("row").alias("member"), "doc_id", "n_shingles", "set_a", "set_b"), "member")
    wanted = common.stored(placed.withColumn("wanted_id", F.coalesce("doc_id", F.lit(2**63 - 1))).drop("doc_id"), "neardup-members")
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a bit map of bounded size tells most other texts before they would be moved
    source = common.likely(source, "id", common.marked(wanted, "wanted_id"))
    # both sides move: were a small one sent to all, each task would hold two Python workers, which stay with the executor
    found = source.join(wanted.hint("merge"), F.col("id") == F.col("wanted_id"))
    sets = common.stored(_same_set(found, size), "neardup-texts")
    placed_blocks = blocked(sets.select("family", "member", "n_shingles"), "family", family_block, "n_shingles", block_shingles)
    tasks = placed_blocks.select("task", "member").join(sets.select("member", "text"), "member")
    linked = components(confirmed(tasks, size, percent, agree), "neardup-links")
    named = linked.join(classes.select(F.col("member").alias("node"), "least"), "node")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    of_class = named.select(F.col("node").alias("member"), "component").join(names, "component").select("member", "name")
    labelled = classes.join(of_class, "member", "left").select("set_a", "set_b", F.coalesce("name", "least").alias("name"), "member")
    every = made.select("doc_id", "key", "row", "n_shingles", "set_a", "set_b").join(labelled, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.nullif("name", F.lit(2**63 - 1)))
    # of rows with the component's id, the one that stands for its class is kept
    alone = F.col("n_shingles") == 0
    kept = alone | (F.col("row") == F.col("member")) & F.col("doc_id").eqNullSafe(component)
    return every.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "key")


def _same_set(found: DataFrame, size: int) -> DataFrame:
    """member, family, n_shingles, text of the rows whose text has the set that was asked for; one for each member.

    Rows that repeat a doc_id may hold other texts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for table in common.blocks(batches):
            sets = shingle_sets(common.texts_of(table), size)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
            same = (digests[:, 0] == table.column("set_a").to_numpy()) & (digests[:, 1] == table.column("set_b").to_numpy())
            yield from table.filter(pa.array(same)).select(["member", "family", "n_shingles", "text"]).to_batches()

    picked = found.select("member", "family", "n_shingles", "text", "set_a", "set_b").mapInArrow(common.tidied(run), "member long, family long, n_shingles long, text string")
    return picked.dropDuplicates(["member"])


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that :func:`near_dedup` keeps, with all their columns; one row of each component."""
    found = common.stored(near_dedup(docs, **options).select("doc_id", "key", "kept"), "neardup-decisions")
    own, kept_id, kept_key = common.fresh(docs, "own_key", "kept_id", "kept_key")
    kept = found.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key))
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    left = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_key)), "left_semi")
    if not found.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)
