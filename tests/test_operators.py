"""Every declarative operator against the checking engine, and hand-computed cases of the rest."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from tideloom import queries
from tideloom.operators import detectors, graphs
from tideloom.plans.registry import OPERATORS, Engine, doubles, oracle
from tideloom.tables import Tables, bound_tables

SF = "/root/testdata/sf0.001"
NAMES = ["events", "documents", "embeddings", "pages", "conversations", "labels"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or isinstance(value, float) and value != value:
        return "NULL"
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


# a spread over all groups; the driver's correctness run covers the rest
SOME = ["ag_agents_board", "ag_trending", "ag_exact_dups", "ag_spam", "ag_influence", "ag_topic_graph", "vx_search", "mx_combined", "fp_compute", "fp_compare", "co_brigading", "co_sockpuppets", "tm_bursts", "tm_xcorr", "tm_circadian", "nv_roles", "nv_timeline", "al_risk", "al_dup_check", "dt_year_week", "wn_role_rank", "src_api_patterns", "jn_range_time_sym"]


@pytest.mark.parametrize("name", SOME)
def test_matches_checking_engine(spark, duck, name):
    found = Engine(bound_tables(spark, SF)).run(name, **OPERATORS[name].test)
    cursor = duck.execute(oracle(name))
    columns = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, cursor.fetchall())


def test_every_query_has_a_name_of_its_own():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(OPERATORS) > 160


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_doubles():
    assert doubles("select 1.5 * x, 'a1.5b', 8.64e10, n.c from t") == "select 1.5e0 * x, 'a1.5b', 8.64e10, n.c from t"


def pairs_of(spark, edges):
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "a string, b string, weight long")


TWO_CLIQUES = [(f"{g}{i}", f"{g}{j}", 2) for g in "ab" for i in range(4) for j in range(i + 1, 4)] + [("a0", "m", 1), ("b0", "m", 1)]


def test_bridge_between_cliques(spark):
    pairs = pairs_of(spark, TWO_CLIQUES)
    bc = {r["author_name"]: r["betweenness"] for r in graphs.betweenness(pairs).collect()}
    assert max(bc, key=bc.get) == "m" or bc["m"] == pytest.approx(max(bc.values()), rel=0.2)
    assert bc["a1"] == 0
    of = {r["author_name"]: r["community"] for r in graphs.communities(pairs).collect()}
    assert len({of[f"a{i}"] for i in range(4)}) == 1 and of["a0"] != of["b0"]
    assert graphs.modularity(pairs, graphs.communities(pairs)).first()["modularity"] > 0.4
    found = graphs.cliques(pairs).collect()
    assert [r["members"] for r in found] == ["a0,a1,a2,a3", "b0,b1,b2,b3"] and found[0]["total_weight"] == 12
    assert {r["component"] for r in graphs.connected(pairs).collect()} == {"a0"}


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("a", "c", 1), ("d", "a", 1)], "src string, dst string, weight long")
    rank = {r["author_name"]: r["pagerank"] for r in graphs.pagerank(edges).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-6) and max(rank, key=rank.get) == "c"


def community(spark, posts, comments):
    p = pd.DataFrame(posts, columns=["id", "title", "content", "author_name", "submolt", "upvotes", "comment_count", "created_at"])
    c = pd.DataFrame(comments, columns=["id", "post_id", "content", "author_name", "upvotes", "created_at"])
    frames = {
        "posts": spark.createDataFrame(p, "id long, title string, content string, author_name string, submolt string, upvotes long, comment_count long, created_at timestamp_ntz"),
        "comments": spark.createDataFrame(c, "id long, post_id long, content string, author_name string, upvotes long, created_at timestamp_ntz"),
    }
    return Tables(spark, frames)


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_self_replies_and_unknown_authors_make_no_edges(spark):
    posts = [(1, "t", "x", "a", "k", 1, 0, at(0)), (2, "t", "x", "b", "k", 1, 0, at(0))]
    comments = [(i, p, "c", who, 0, at(i)) for i, (p, who) in enumerate([(1, "b"), (1, "b"), (1, "a"), (1, None), (2, "a"), (1, "b")])]
    engine = Engine(community(spark, posts, comments), "2024-01-02 00:00:00")
    assert {(r["a"], r["b"], r["weight"]) for r in engine.run("gr_undirected").collect()} == {("a", "b", 4)}


def test_spam_rules(spark):
    long = "long enough to say something of substance, surely so"
    posts = [
        (1, "fine title", "short", "a", "k", 5, 1, at(47)), (2, "ab", long, "b", "k", 5, 1, at(47)), (3, "test", long, "c", "k", 5, 1, at(47)), (4, "x", "y", "d", "k", 0, 0, at(47)),
        *[(10 + i, "title", "tiny", "quick", "k", 1, 1, at(47.5)) for i in range(11)],
    ]
    got = {r["id"]: (r["spam_score"], r["reasons"]) for r in Engine(community(spark, posts, []), "2024-01-03 00:00:00").run("ag_spam").collect()}
    assert got[1] == (30, "short_content;") and got[2] == (20, "generic_title;") and 3 not in got
    assert got[4] == (60, "short_content;generic_title;no_engagement;") and got[10] == (70, "short_content;high_velocity;")


def test_trending_needs_a_positive_past(spark):
    posts = [(i, "t", "c", who, "k", up, 0, at(h)) for i, (who, up, h) in enumerate([("a", 2, 38), ("a", 9, 44), ("a", 9, 45), ("z", 0, 38), ("z", 9, 44), ("z", 9, 45)])]
    got = Engine(community(spark, posts, []), at(47).isoformat(" ")).run("ag_trending").collect()
    assert [(r["author_name"], r["growth_percent"]) for r in got] == [("a", 350.0)]


def test_topics_are_learned_from_all_authors(spark, monkeypatch):
    used = []

    class Spy(detectors.LDA):
        def fit(self, rows):
            used.append((self.getMaxIter(), self.getSubsamplingRate()))
            return super().fit(rows)

    monkeypatch.setattr(detectors, "LDA", Spy)
    got = queries.mx_topic(spark, SF).groupBy("author_name").sum("share").collect()
    assert used == [(10, 1.0)] and got and all(abs(r[1] - 1) < 1e-6 for r in got)


def test_modularity_of_a_ring_of_cliques(spark):
    """Twelve cliques of five in a ring: each is a community, as the known best partition has it."""
    edges = [(f"g{g:02}n{i}", f"g{g:02}n{j}", 1) for g in range(12) for i in range(5) for j in range(i + 1, 5)] + [(f"g{g:02}n0", f"g{(g + 1) % 12:02}n1", 1) for g in range(12)]
    pairs = pairs_of(spark, edges)
    of = {r["author_name"]: r["community"] for r in graphs.communities(pairs).collect()}
    assert all(len({of[f"g{g:02}n{i}"] for i in range(5)}) == 1 for g in range(12))
    q = graphs.modularity(pairs, graphs.communities(pairs)).first()["modularity"]
    assert q >= 10 / 11 - 1 / 12 - 1e-9


def test_topics_raise_the_combined_value(spark):
    engine = Engine(bound_tables(spark, SF))
    without, counted = (engine.run("mx_combined", counted_topics=c).toPandas().set_index(["author1", "author2"])["value"].sort_index() for c in (False, True))
    assert len(without) == len(counted) and (counted >= without - 1e-4).all() and (counted > without).any()


def test_alerts_follow_the_detectors(spark):
    found = spark.createDataFrame([(12.0, 0.9, "a"), (12.0, 0.1, "b"), (6.0, 0.9, "c"), (1.0, 0.9, "d")], "coordination_score double, fingerprint_similarity double, who string")
    from pyspark.sql import functions as F

    score = F.col("coordination_score")
    got = {r["who"]: (r["severity"], r["confidence"]) for r in detectors.graded(found, "x", [((score > 10) & (F.col("fingerprint_similarity") > 0.8), "critical"), (score > 8, "high"), (score > 5, "medium")], F.least(score / 12, F.lit(1.0))).collect()}
    assert got == {"a": ("critical", 1.0), "b": ("high", 1.0), "c": ("medium", 0.5)}


def test_weeks_of_two_years_differ(spark):
    posts = [(i, "t", "c", "a", "k", 1, 0, dt.datetime(year, 1, 10, hour)) for i, (year, hour) in enumerate([(2023, 3), (2024, 15)])]
    got = Engine(community(spark, posts, []), "2024-02-01 00:00:00").run("fp_change").collect()
    assert [(r["author_name"], r["delta"]) for r in got] == [("a", 1.0)]


def test_declared_queries_have_rows(duck):
    """No oracle compares nothing with nothing on the smallest tables."""
    few = [name for name, sql in driver.oracle_sql().items() if name.startswith(("vx_", "nv_", "mx_similar", "jn_range")) and not duck.execute(sql).fetchall()]
    assert few == []
