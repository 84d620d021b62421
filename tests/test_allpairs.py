"""Pairs by tiles of products against the plain plans, on few and odd rows; no plan may join all rows with all."""

import contextlib
import io

import pytest

from tideloom.operators import allpairs, detectors
from tideloom.plans.registry import Engine
from tideloom.tables import Tables

from .test_operators import at, community, rows

NESTED = ("NestedLoop", "CartesianProduct")


def plan_of(frame):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        frame.explain()
    return text.getvalue()


def plain(engine, name, **params):
    found = engine.spark.sql(engine.sql(name, **params))
    return rows(found.columns, found.collect())


@pytest.fixture
def vectors(spark, monkeypatch):
    monkeypatch.setattr(allpairs, "STRIP", 3)
    tables = community(spark, [(i, "t", "x", f"a{i}", "k", i % 3, 0, at(i)) for i in range(12)], [(1, 1, "c", "a2", 0, at(1))])
    some = [(i, "post", [float((i * 7) % 5), float(i % 4), 1.0]) for i in range(9)]
    odd = [(9, "post", None), (10, "post", [0.0, 0.0, 0.0]), (11, "post", [1.0, 2.0]), (3, "comment", [1.0, 1.0, 1.0]), (99, "post", [0.0, 0.0, 1.0]), (98, "post", [1.0, None, 1.0])]
    embs = spark.createDataFrame(some + odd, "content_id long, content_type string, embedding array<float>")
    return Engine(Tables(spark, {**tables.frames, "embs": embs}), "2024-01-03 00:00:00")


def test_near_dups_by_tiles(vectors):
    found = vectors.run("ag_near_dups", threshold=0.5, k=9)
    assert not any(word in plan_of(found) for word in NESTED)
    got = rows(found.columns, found.collect())
    assert len(got) == 9 and got == plain(vectors, "ag_near_dups", threshold=0.5, k=9)
    same = vectors.run("mx_content_sim", threshold=0.6)
    assert rows(same.columns, same.collect()) == plain(vectors, "mx_content_sim", threshold=0.6)


@pytest.fixture
def people(spark, monkeypatch):
    monkeypatch.setattr(allpairs, "STRIP", 3)
    posts = [(i, "t", f"the model and data {'with you!' * (i % 3)}", f"a{i % 7}", f"k{i % 2}", i % 3, i % 2, at(i * (1 + i % 4))) for i in range(40)]
    comments = [(100 + i, i % 40, "this is new, that is good?" if i % 2 else "FAR 12 (x)", f"a{(i * 3) % 8}" if i % 9 else None, i % 4, at(i * 2)) for i in range(30)]
    return Engine(community(spark, posts, comments), "2024-01-08 00:00:00")


@pytest.mark.parametrize("name, params", [
    ("fp_similarity", {}), ("co_sockpuppets", {"overall": 0.3, "temporal": 0.0, "k": 4}), ("co_sock_network", {"overall": 0.3, "temporal": 0.0, "least": 0.2, "k": 3}),
    ("al_sockpuppet", {"overall": 0.3, "temporal": 0.0}), ("mx_combined", {}), ("mx_combined", {"counted_topics": True}),
])
@pytest.mark.parametrize("few_keys", [1024, 0])
def test_authors_by_tiles(people, monkeypatch, name, params, few_keys):
    monkeypatch.setattr(allpairs, "FEW_KEYS", few_keys)
    found = people.run(name, **params)
    assert "FlatMapGroupsInArrow" in plan_of(found) and "Join" not in plan_of(found).split("FlatMapGroupsInArrow")[0]
    got = rows(found.columns, found.collect())
    assert got and got == plain(people, name, **params)


def test_pushes_compare_only_authors_of_a_window(spark, people, monkeypatch):
    run, ran = Engine.run, []
    monkeypatch.setattr(Engine, "run", lambda self, name, *a, **k: ran.append(name) or run(self, name, *a, **k))
    posts = people.tables["posts"]
    told = posts.selectExpr("id as post_id", "concat('n', id % 2) as narrative_id", "created_at")
    engine = Engine(Tables(spark, {**people.tables.frames, "narrative_posts": told}), "2024-01-08 00:00:00")
    got = {(r["narrative_id"], r["post_id"]): r for r in detectors.pushes(engine, hours=20, days=30).collect()}
    assert got and "fp_similarity" not in ran
    alike = {(r["author1"], r["author2"]): r["similarity"] for r in engine.run("fp_similarity").collect()}
    for r in got.values():
        names = sorted(r["members"].split(","))
        mean = [alike[a, b] for i, a in enumerate(names) for b in names[i + 1 :] if (a, b) in alike]
        assert r["fingerprint_similarity"] == pytest.approx(sum(mean) / len(mean), abs=6e-4)


def test_rhythm_groups_keep_no_pairs(people, monkeypatch):
    run, ran = Engine.run, []
    monkeypatch.setattr(Engine, "run", lambda self, name, *a, **k: ran.append(name) or run(self, name, *a, **k))
    got = [(r["leader"], r["members"], r["least_similarity"]) for r in detectors.bot_farms(people, threshold=0.3, least=3, least_members=2, k=50).collect()]
    assert ran == []
    near = {}
    for r in people.run("tm_profile_pairs", least=3, threshold=0.3).collect():
        near.setdefault(r["author1"], []).append((r["author2"], r["similarity"]))
    used, want = set(), []
    for leader in sorted(near):
        own = [(b, s) for b, s in sorted(near[leader]) if b not in used]
        if leader not in used and own:
            used.update([leader, *(b for b, _ in own)])
            want.append((leader, ",".join([leader, *(b for b, _ in own)]), min(s for _, s in own)))
    assert want and sorted(got) == sorted(want)


@pytest.mark.parametrize("block", [4096, 4])
def test_neighbours_in_time_by_buckets(spark, monkeypatch, block):
    import functools

    monkeypatch.setattr(allpairs, "STRIP", 3)
    monkeypatch.setattr(allpairs, "near_in_time", functools.partial(allpairs.near_in_time, block=block))
    times = [at(h / 4) for h in [0, 0, 1, 1, 1, 2, 2, 3, 4, 4, 5, 5, 5, 5, 8, 9, 40, 41, 43, 47]]
    tables = community(spark, [(i, "t", "x", f"a{i}", "k", 0, 0, when) for i, when in enumerate([*times, None])], [(1, 1, "c", "a2", 0, at(1))])
    some = [(i, "post", [float((i * 7) % 5), float(i % 4), 1.0]) for i in range(17)] + [(20, "post", [1.0, 1.0, 1.0]), (3, "comment", [1.0, 1.0, 1.0])]
    odd = [(17, "post", None), (18, "post", [0.0, 0.0, 0.0]), (19, "post", [1.0, 2.0])]
    embs = spark.createDataFrame(some + odd, "content_id long, content_type string, embedding array<float>")
    engine = Engine(Tables(spark, {**tables.frames, "embs": embs}), "2024-01-03 00:00:00")
    for minutes in (30, 45):
        found = engine.run("jn_range_time_sym", minutes=minutes, threshold=0.5)
        assert "FlatMapGroupsInArrow" in plan_of(found) and "Join" not in plan_of(found)
        got = rows(found.columns, found.collect())
        assert len(got) > 9 and got == plain(engine, "jn_range_time_sym", minutes=minutes, threshold=0.5)


def test_rules_share_what_costs_most(spark, people, monkeypatch):
    """Fingerprints are made once for all rules, and near pairs are found once, not at each of their uses."""
    from tideloom.operators import detectors as rules

    made, kept = [], []
    monkeypatch.setattr(allpairs, "stored", lambda df, tag, f=allpairs.stored: made.append(tag) or f(df, tag))
    monkeypatch.setattr(rules, "stored", lambda df, tag, f=rules.stored: kept.append(tag) or f(df, tag))
    posts = people.tables["posts"]
    told = posts.selectExpr("id as post_id", "concat('n', id % 2) as narrative_id", "created_at")
    embs = posts.selectExpr("id as content_id", "'post' as content_type", "array(cast(id % 3 as float), 1f) as embedding")
    engine = Engine(Tables(spark, {**people.tables.frames, "narrative_posts": told, "embs": embs}), "2024-01-08 00:00:00")
    tests = {"al_sockpuppet": {"overall": 0.3, "temporal": 0.0}, "al_sync": {"low": 0.0, "high": 0.1, "minutes": 300, "threshold": 0.1}, "al_push": {"critical": 0.05, "high": 0.02, "medium": 0.01, "alike": 0.5, "hours": 20, "days": 30}}
    got = {(r["rule"], r["severity"]): r["alerts"] for r in rules.all_alerts(engine, tests).collect()}
    assert made.count("print-style") == 1 and kept.count("sync-pairs") == 1
    for rule, params in tests.items():
        found = rules.DETECTED[rule](engine, **params) if rule in rules.DETECTED else engine.run(rule, **params)
        assert {(rule, r["severity"]): r["count"] for r in found.groupBy("severity").count().collect()} == {k: n for k, n in got.items() if k[0] == rule} != {}


def test_recurring_texts_are_read_once_and_not_kept(spark):
    """Fingerprints from each text's counts are those of the plans, and no text is kept with the posts and comments."""
    from tideloom.tables import bound_tables

    tables = bound_tables(spark, "/root/testdata/sf0.001")
    assert "content" not in tables.lean["posts"].columns and not tables.frames["posts"].is_cached and not tables.frames["comments"].is_cached
    engine = Engine(tables)
    found = allpairs.fingerprint_rows(engine, engine.dialect()).selectExpr("author_name", "explode(arrays_zip(dims, v)) as z").selectExpr("author_name", "z.dims as dim", "round(z.v, 4) as v")
    assert rows(found.columns, found.collect()) == plain(engine, "fp_compute")


def test_push_windows_keep_no_names(spark, people):
    """Windows of many posts give on numbers alone; members are named for the pushes that are kept."""
    told = people.tables["posts"].selectExpr("id as post_id", "'n' as narrative_id", "created_at")
    engine = Engine(Tables(spark, {**people.tables.frames, "narrative_posts": told}), "2024-01-08 00:00:00")
    posts = engine.query(lambda d: detectors.narrative_posts(d, 30))
    found = allpairs.push_windows(posts, allpairs.fingerprint_rows(engine, engine.dialect()), 20 * 3_600_000_000, 3)
    assert "names" not in found.columns
    got = sorted((r["post_id"], r["authors"], r["posts"]) for r in found.collect())
    assert got and got == sorted((r["post_id"], r["authors"], r["posts"]) for r in engine.run("nv_pushes", hours=20, least=3, days=30).collect())


@pytest.mark.parametrize("name, k", [("co_sockpuppets", 50), ("co_sock_network", 100)])
def test_default_limits_hold_within_tiles(people, monkeypatch, name, k):
    given = []
    monkeypatch.setattr(allpairs, "alike", lambda rows, *limits, f=allpairs.alike: given.append(limits) or f(rows, *limits))
    found = people.run(name, overall=0.3, temporal=0.0)
    assert given[0][-1] == k and rows(found.columns, found.collect()) == plain(people, name, overall=0.3, temporal=0.0)
