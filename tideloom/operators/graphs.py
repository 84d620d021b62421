"""The reply graph: centralities, communities, cliques, and what follows from them.

Joins and sums stay declarative; loops write each round to the shared folder, so lineage stays short.  Only
:func:`betweenness` and :func:`cliques` run Python on adjacency lists, which a task reads for the whole author graph: its
size is bounded by the number of authors who replied in the window, and checked against ``most_edges``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import Engine, operator
from ..functions.dialect import Dialect
from ..store import stored


# ---- declarative part ----------------------------------------------------------------------------------------


def built(d: Dialect, days: float) -> str:
    """Directed reply counts of a window, without replies to oneself."""
    return f"""select c.author_name as src, p.author_name as dst, count(*) as weight from {d.comments} c join {d.posts} p on p.id = c.post_id
        where c.author_name is not null and p.author_name is not null and c.author_name <> p.author_name and c.created_at > {d.ago(24 * days)} group by c.author_name, p.author_name"""


def undirected(d: Dialect, days: float) -> str:
    """Both directions summed: reciprocal pairs count all their replies."""
    return f"select least(src, dst) as a, greatest(src, dst) as b, sum(weight) as weight from ({built(d, days)}) g group by least(src, dst), greatest(src, dst)"


@operator("gr_build")
def gr_build(d: Dialect, days: float = 30) -> str:
    return built(d, days)


@operator("gr_undirected")
def gr_undirected(d: Dialect, days: float = 30) -> str:
    return undirected(d, days)


def both_ways(d: Dialect, days: float) -> str:
    return f"select a as x, b as y, weight as w from ({undirected(d, days)}) u union all select b, a, weight from ({undirected(d, days)}) u"


@operator("gr_degree_centrality")
def degree_centrality(d: Dialect, days: float = 30) -> str:
    return f"with s as ({both_ways(d, days)}) select x as author_name, count(*) as degree, round(count(*) * 1.0 / ((select count(distinct x) from s) - 1), 5) as centrality from s group by x"


@operator("gr_triangles")
def triangles(d: Dialect, days: float = 30) -> str:
    return f"with u as ({undirected(d, days)}) select count(*) as triangles from u p join u q on p.b = q.a join u r on r.a = p.a and r.b = q.b"


def graph(engine: Engine, days: float = 30) -> tuple[DataFrame, DataFrame]:
    """Directed (src, dst, weight) and undirected (a, b, weight) edges of a window, written once."""
    return stored(engine.run("gr_build", days=days), "reply-graph"), stored(engine.run("gr_undirected", days=days), "reply-pairs")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """author_name, pagerank of a directed weighted graph, to an L1 change below n * tolerance."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = stored(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "rank-shares")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    nodes = stored(nodes.join(total.select(F.col("src").alias("id"), F.lit(True).alias("sends")), "id", "left"), "rank-nodes")
    n = nodes.count()
    now = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for step in range(most):
        lost = now.filter("sends is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).first()["lost"]
        got = shares.join(now.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        nxt = now.withColumnRenamed("rank", "before").join(got, "id", "left").withColumn("rank", (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n))
        nxt = stored(nxt.select("id", "sends", "before", "rank"), "rank-step")
        moved = nxt.agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("m")).first()["m"]
        now = nxt.drop("before")
        if moved is None or moved < n * tolerance:
            break
    return now.select(F.col("id").alias("author_name"), F.col("rank").alias("pagerank"))


def eigenvector(pairs: DataFrame, most: int = 500, tolerance: float = 1e-6) -> DataFrame:
    """author_name, eigenvector centrality; the share of neighbours where the loop does not settle."""
    s = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").union(pairs.select("b", "a", "weight"))
    s = stored(s, "eigen-edges")
    now = s.groupBy(F.col("x").alias("id")).agg(F.count("*").alias("degree")).withColumn("v", F.lit(1.0))
    n = now.count()
    now = stored(now.withColumn("v", F.lit(1.0 / max(n, 1) ** 0.5)), "eigen-step")
    for _ in range(most):
        got = s.join(now.select(F.col("id").alias("y"), F.col("v").alias("w")), "y").groupBy(F.col("x").alias("id")).agg(F.sum(F.col("weight") * F.col("w")).alias("got"))
        grown = stored(now.withColumnRenamed("v", "before").join(got, "id").withColumn("raw", F.col("before") + F.col("got")), "eigen-raw")
        norm = grown.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("n")).first()["n"] or 1.0
        nxt = grown.select("id", "degree", "before", (F.col("raw") / norm).alias("v"))
        moved = nxt.agg(F.sum(F.abs(F.col("v") - F.col("before"))).alias("m")).first()["m"]
        now = nxt.drop("before")
        if moved is None or moved < n * tolerance:
            return now.select(F.col("id").alias("author_name"), F.col("v").alias("eigenvector"))
    return now.select(F.col("id").alias("author_name"), (F.col("degree") / max(n - 1, 1)).alias("eigenvector"))


def connected(pairs: DataFrame, most: int = 50) -> DataFrame:
    """author_name, component (its least name) by label spreading with jumps to the label's own label."""
    s = stored(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a")), "parts-edges")
    now = stored(s.select(F.col("x").alias("id")).distinct().withColumn("label", F.col("id")), "parts-step")
    for _ in range(most):
        near = s.join(now.select(F.col("id").alias("y"), "label"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        one = now.join(near, "id").select("id", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = one.select(F.col("id").alias("label"), F.col("label").alias("further"))
        nxt = stored(one.join(jump, "label", "left").select("id", "before", F.least("label", F.coalesce("further", "label")).alias("label")), "parts-step")
        if nxt.filter("label <> before").isEmpty():
            return nxt.select(F.col("id").alias("author_name"), F.col("label").alias("component"))
        now = nxt.drop("before")
    raise RuntimeError("components did not settle")


def local_moves(s: DataFrame, total: float, most: int) -> DataFrame:
    """id, label: each node starts alone and moves to the neighbouring community of the largest modularity gain, while any gains.

    ``s`` has the edges both ways (x, y, weight), with twice the inner weight of a merged node as (x, x).  In each round
    half of the nodes, drawn by a hash of node and round, may move, so that neighbours seldom swap places; a level ends after ``most``
    rounds, and the next one goes on with what it left.
    """
    strength = stored(s.groupBy(F.col("x").alias("id")).agg(F.sum("weight").alias("k")), "community-strength")
    links = stored(s.filter("x <> y"), "community-links")
    now = strength.select("id", "k", F.col("id").alias("label"))
    still = 0
    for step in range(most):
        sums = now.groupBy(F.col("label").alias("to")).agg(F.sum("k").alias("of_label"))
        into = links.join(now.select(F.col("id").alias("y"), F.col("label").alias("to")), "y").groupBy(F.col("x").alias("id"), "to").agg(F.sum("weight").alias("w"))
        stay = now.select("id", F.col("label").alias("to"), F.lit(0.0).alias("w"))
        choices = into.unionByName(stay).groupBy("id", "to").agg(F.sum("w").alias("w")).join(now, "id").join(sums, "to")
        others = F.col("of_label") - F.when(F.col("to") == F.col("label"), F.col("k")).otherwise(F.lit(0.0))
        gain = F.round(F.col("w") - F.col("k") * others / total, 9)
        # of equal gains the own label comes first, then the least
        best = choices.groupBy("id", "k", "label").agg(F.max_by("to", F.struct(gain, F.col("to") == F.col("label"), -F.xxhash64("to"))).alias("best"))
        turn = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(2)) == 0
        nxt = stored(best.select("id", "k", F.col("label").alias("before"), F.when(turn, F.col("best")).otherwise(F.col("label")).alias("label"), (F.col("best") != F.col("label")).alias("wants")), "community-step")
        still = nxt.filter("wants").isEmpty()
        now = nxt.select("id", "k", "label")
        if still:
            break
    return now.select("id", "label")


def communities(pairs: DataFrame, most_rounds: int = 10, most_levels: int = 20) -> DataFrame:
    """author_name, community by modularity: local moves, then the communities are merged to nodes, until nothing moves.

    A community bears its least member's name.
    """
    s = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("weight").cast("double").alias("weight"))
    s = stored(s.union(s.select("y", "x", "weight")), "community-edges")
    total = s.agg(F.sum("weight")).first()[0] or 1.0
    of = stored(s.select(F.col("x").alias("author_name")).distinct().withColumn("node", F.col("author_name")), "community-of")
    n = of.count()
    for _ in range(most_levels):
        moved = local_moves(s, total, most_rounds)
        of = stored(of.join(moved, F.col("node") == F.col("id")).select("author_name", F.col("label").alias("node")), "community-of")
        left = of.select("node").distinct().count()
        if left == n:
            break
        n = left
        to = moved.withColumnRenamed("label", "to")
        merged = s.join(to.withColumnRenamed("id", "x"), "x").select(F.col("to").alias("x"), "y", "weight").join(to.withColumnRenamed("id", "y"), "y")
        s = stored(merged.groupBy("x", F.col("to").alias("y")).agg(F.sum("weight").alias("weight")), "community-edges")
    names = of.groupBy("node").agg(F.min("author_name").alias("community"))
    return of.join(names, "node").select("author_name", "community")


def modularity(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """community, members, size and the modularity of the whole partition."""
    ends = pairs.select(F.col("a").alias("author_name"), "weight").union(pairs.select("b", "weight"))
    strength = ends.groupBy("author_name").agg(F.sum("weight").alias("k")).join(groups, "author_name").groupBy("community").agg(F.sum("k").alias("k"))
    ga, gb = groups.select(F.col("author_name").alias("a"), F.col("community").alias("ca")), groups.select(F.col("author_name").alias("b"), F.col("community").alias("cb"))
    inside = pairs.join(ga, "a").join(gb, "b").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    m = pairs.agg(F.sum("weight").alias("m"))
    parts = strength.join(inside, "community", "left").crossJoin(m)  # one row
    q = parts.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - (F.col("k") / (2 * F.col("m"))) ** 2).alias("modularity"))
    return groups.groupBy("community").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("author_name")).alias("members")).crossJoin(q)


def _adjacency(pairs: DataFrame, most_edges: int) -> list[tuple[str, str, float]]:
    n = pairs.count()
    if n > most_edges:
        raise ValueError(f"{n} edges are too many for one task's adjacency; narrow the window or raise most_edges")
    return [(r["a"], r["b"], float(r["weight"])) for r in pairs.collect()]


def betweenness(pairs: DataFrame, k: int | None = None, seed: int = 7, by_distance: bool = True, most_edges: int = 2_000_000) -> DataFrame:
    """author_name, betweenness by shortest paths from every author, or from ``k`` seeded ones where there are more.

    Weights count as distances unless ``by_distance`` is false.  Sources are spread over tasks; each
    runs on a broadcast adjacency whose size is checked first.
    """
    edges = _adjacency(pairs, most_edges)
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w if by_distance else 1.0))
        near.setdefault(b, []).append((a, w if by_distance else 1.0))
    shared = pairs.sparkSession.sparkContext.broadcast(near)
    sources = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()
    n = len(near)
    used = n
    if k is not None and n > k:
        sources, used = sources.orderBy(F.xxhash64("s", F.lit(seed)), "s").limit(k), k

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        adjacency = shared.value
        total: dict[str, float] = {}
        for frame in frames:
            for s in frame["s"]:
                dist, count, before, done = {s: 0.0}, {s: 1.0}, {s: []}, []
                heap = [(0.0, s)]
                seen = set()
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in seen:
                        continue
                    seen.add(v)
                    done.append(v)
                    for u, w in adjacency[v]:
                        nd = d + w
                        if u not in dist or nd < dist[u] - 1e-12:
                            dist[u], count[u], before[u] = nd, count[v], [v]
                            heapq.heappush(heap, (nd, u))
                        elif abs(nd - dist[u]) <= 1e-12 and u not in seen:
                            count[u] += count[v]
                            before[u].append(v)
                part = dict.fromkeys(done, 0.0)
                for v in reversed(done):
                    for p in before[v]:
                        part[p] += count[p] / count[v] * (1 + part[v])
                    if v != s:
                        total[v] = total.get(v, 0.0) + part[v]
        yield pd.DataFrame({"author_name": list(total), "part": list(total.values())})

    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / max(used, 1))
    summed = sources.repartition(8).mapInPandas(run, "author_name string, part double").groupBy("author_name").agg(F.sum("part").alias("part"))
    every = pairs.select(F.col("a").alias("author_name")).union(pairs.select("b")).distinct()
    return every.join(summed, "author_name", "left").select("author_name", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def cliques(pairs: DataFrame, least: int = 3, k: int = 30, most_edges: int = 2_000_000) -> DataFrame:
    """The largest maximal cliques: members, size, total and mean weight.  Each task extends the cliques whose least member it holds."""
    edges = _adjacency(pairs, most_edges)
    near: dict[str, set[str]] = {}
    weight: dict[tuple[str, str], float] = {}
    for a, b, w in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        weight[min(a, b), max(a, b)] = w
    shared = pairs.sparkSession.sparkContext.broadcast((near, weight))
    starts = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adjacency, weights = shared.value

        def grow(own: list[str], may: set[str], past: set[str]) -> Iterator[list[str]]:
            if not may and not past:
                yield own
                return
            pivot = max(may | past, key=lambda u: (len(adjacency[u] & may), u))
            for v in sorted(may - adjacency[pivot]):
                yield from grow([*own, v], may & adjacency[v], past & adjacency[v])
                may = may - {v}
                past = past | {v}

        for frame in frames:
            rows = []
            for s in frame["s"]:
                later = {u for u in adjacency[s] if u > s}
                for own in grow([s], later, adjacency[s] - later):
                    if len(own) >= least:
                        total = sum(weights[min(a, b), max(a, b)] for i, a in enumerate(own) for b in own[i + 1 :])
                        rows.append((",".join(sorted(own)), len(own), total, total / (len(own) * (len(own) - 1) / 2)))
            rows.sort(key=lambda r: (-r[1], -r[2], r[0]))
            yield pd.DataFrame(rows[:k], columns=["members", "size", "total_weight", "avg_weight"])

    found = starts.repartition(8).mapInPandas(run, "members string, size long, total_weight double, avg_weight double")
    return found.orderBy(F.desc("size"), F.desc("total_weight"), "members").limit(k)


# ---- reports -------------------------------------------------------------------------------------------------


def metrics(engine: Engine, days: float = 30, k: int | None = 100) -> DataFrame:
    """author_name with degree, pagerank, betweenness, eigenvector and community."""
    edges, pairs = graph(engine, days)
    n = pairs.select("a").union(pairs.select("b")).distinct().count()
    out = engine.run("gr_degree_centrality", days=days).select("author_name", "degree")
    for part in (pagerank(edges), betweenness(pairs, k if n > 500 else None), eigenvector(pairs), communities(pairs)):
        out = out.join(part, "author_name", "left")
    return stored(out, "graph-metrics")


def all_metrics(engine: Engine, days: float = 30) -> DataFrame:
    """One row per author and metric."""
    m = metrics(engine, days)
    return m.select("author_name", F.expr("stack(4, 'pagerank', pagerank, 'betweenness', betweenness, 'eigenvector', eigenvector, 'degree', cast(degree as double)) as (metric_name, metric_value)"))


def top_influencers(engine: Engine, metric: str = "pagerank", k: int = 20, days: float = 30) -> DataFrame:
    return all_metrics(engine, days).filter(F.col("metric_name") == metric).orderBy(F.desc("metric_value"), "author_name").limit(k)


def bridges(engine: Engine, days: float = 30, least: float = 0.01, k: int = 30) -> DataFrame:
    """Authors between communities: betweenness times cross links over degree."""
    m = metrics(engine, days)
    _, pairs = graph(engine, days)
    ends = pairs.select(F.col("a").alias("author_name"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    other = m.select(F.col("author_name").alias("other"), F.col("community").alias("theirs"))
    cross = ends.join(m.select("author_name", "community"), "author_name").join(other, "other").groupBy("author_name").agg(F.sum(F.when(F.col("community") != F.col("theirs"), 1).otherwise(0)).alias("cross"))
    found = m.join(cross, "author_name").filter(F.col("betweenness") >= least)
    return found.select("author_name", "betweenness", "cross", "degree", (F.col("betweenness") * F.col("cross") / F.col("degree")).alias("score")).orderBy(F.desc("score"), "author_name").limit(k)


def gatekeepers(engine: Engine, days: float = 30, least: float = 0.01, k: int = 30) -> DataFrame:
    m = metrics(engine, days).filter(F.col("betweenness") > least)
    return m.select("author_name", "betweenness", "degree", (F.col("betweenness") / F.log1p(F.col("degree"))).alias("score")).orderBy(F.desc("score"), "author_name").limit(k)


def position(engine: Engine, author: str, days: float = 30) -> DataFrame:
    """An author's metrics and ten strongest neighbours."""
    m = metrics(engine, days).filter(F.col("author_name") == author)
    edges, pairs = graph(engine, days)
    ends = pairs.filter((F.col("a") == author) | (F.col("b") == author)).select(F.when(F.col("a") == author, F.col("b")).otherwise(F.col("a")).alias("other"), "weight").orderBy(F.desc("weight"), "other").limit(10)
    ways = edges.agg(F.count(F.when(F.col("src") == author, 1)).alias("out_degree"), F.count(F.when(F.col("dst") == author, 1)).alias("in_degree"))
    return m.crossJoin(ways).crossJoin(ends.agg(F.array_join(F.sort_array(F.collect_list("other")), ",").alias("neighbours")))


def summary(engine: Engine, days: float = 30) -> DataFrame:
    """Size, density, components and mean clustering of the graph, as one row."""
    edges, pairs = graph(engine, days)
    s = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    degree = s.groupBy("x").agg(F.count("*").alias("deg"))
    p, q, r = (pairs.select(F.col("a").alias(f"{n}a"), F.col("b").alias(f"{n}b")) for n in "pqr")
    tri = p.join(q, F.col("pb") == F.col("qa")).join(r, (F.col("ra") == F.col("pa")) & (F.col("rb") == F.col("qb"))).select(F.explode(F.array("pa", "pb", "qb")).alias("x")).groupBy("x").agg(F.count("*").alias("tri"))
    local = degree.join(tri, "x", "left").select(F.when(F.col("deg") > 1, 2 * F.coalesce("tri", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1))).otherwise(F.lit(0.0)).alias("c"))
    parts = connected(pairs).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    size = degree.agg(F.count("*").alias("nodes"), F.avg("deg").alias("avg_degree"))
    m = pairs.agg(F.count("*").alias("edges"))
    out = size.crossJoin(m).crossJoin(edges.agg(F.count("*").alias("directed_edges"))).crossJoin(parts).crossJoin(local.agg(F.round(F.avg("c"), 4).alias("avg_clustering")))  # one row each
    return out.select("nodes", "edges", "directed_edges", F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 5).alias("density"), F.round("avg_degree", 3).alias("avg_degree"), "components", "largest", "avg_clustering")
