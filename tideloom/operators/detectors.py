"""Detectors that need order-dependent grouping, clustering or machine learning, and the jobs that run several of them.

Candidates come from declarative plans.  The greedy part then runs for one connected set of candidates at a time
(one narrative, one chain of overlapping times), never over the whole table in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import Spark
from ..plans.registry import Engine, doubles
from ..store import stored
from . import allpairs, fingerprints, graphs
from .narratives import narrative_posts
from .relational import theta_pairs
from .temporal import profile_hours
from .topics import LDA, vocabulary_counts


def sync_posting(engine: Engine, minutes: int = 30, threshold: float = 0.7, least: int = 3, k: int = 30, as_of: str | None = None) -> DataFrame:
    """Groups of posts by different authors, close in time and content; greedy in time order, each post used once.

    Posts whose gaps exceed the window can never share a group, so each chain of closer posts is one task's work.
    """
    # read five times below
    pairs = stored(engine.run("jn_range_time_sym", as_of=as_of, minutes=minutes, threshold=threshold), "sync-pairs")
    posts = engine.tables.without_texts("posts").select("id", "author_name", "created_at")
    both = pairs.select(F.col("id1").alias("id"), F.col("id2").alias("other"), "similarity").union(pairs.select("id2", "id1", "similarity"))
    near = both.groupBy("id").agg(F.collect_list(F.struct("other", "similarity")).alias("near"))
    rows = near.join(posts, "id").withColumn("t", F.unix_micros(F.col("created_at").cast("timestamp")) / 6e7)
    chains = graphs.connected(pairs.select(F.col("id1").cast("string").alias("a"), F.col("id2").cast("string").alias("b")))
    rows = rows.join(chains.select(F.col("author_name").cast("long").alias("id"), F.col("component").alias("chain")), "id")

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "id"])
        when, who = dict(zip(frame["id"], frame["t"])), dict(zip(frame["id"], frame["author_name"]))
        used, out = set(), []
        for seed, near_by in zip(frame["id"], frame["near"]):
            if seed in used:
                continue
            found = [(r["other"], r["similarity"]) for r in near_by if r["other"] not in used and when[r["other"]] >= when[seed]]
            members = [seed] + [f[0] for f in found]
            authors = sorted({who[m] for m in members if who[m] is not None})
            if len(authors) >= least:
                used.update(members)
                spread = max(when[m] for m in members) - min(when[m] for m in members)
                mean = sum(f[1] for f in found) / max(len(found), 1)
                out.append((int(seed), ",".join(authors), len(authors), len(members), float(mean), float(spread), float(mean * len(authors) / (spread + 1))))
        return pd.DataFrame(out, columns=["seed", "authors", "n_authors", "n_posts", "similarity", "spread_minutes", "score"])

    found = rows.groupBy("chain").applyInPandas(group, "seed long, authors string, n_authors long, n_posts long, similarity double, spread_minutes double, score double")
    return found.orderBy(F.desc("score"), "seed").limit(k)


def clusters(engine: Engine, threshold: float = 0.3, least: int = 3, k: int = 20) -> DataFrame:
    """Communities of the combined similarity of authors: cohesion (mean weight times density) and score."""
    pairs = combined_matrix(engine, above=threshold).select(F.col("author1").alias("a"), F.col("author2").alias("b"), F.col("value").alias("weight"))
    pairs = stored(pairs, "cluster-pairs")
    of = graphs.communities(pairs)
    a, b = of.select(F.col("author_name").alias("a"), F.col("community").alias("ca")), of.select(F.col("author_name").alias("b"), F.col("community").alias("cb"))
    inner = pairs.join(a, "a").join(b, "b").filter("ca = cb").groupBy("ca").agg(F.avg("weight").alias("mean"), F.count("*").alias("links"))
    sized = of.groupBy(F.col("community").alias("ca")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("author_name")), ",").alias("members")).filter(F.col("n") >= least)
    cohesion = F.col("mean") * (2 * F.col("links") / (F.col("n") * (F.col("n") - 1)))
    return inner.join(sized, "ca").select(F.col("ca").alias("cluster_id"), "members", "n", cohesion.alias("cohesion"), (cohesion * F.log1p("n")).alias("score")).orderBy(F.desc("score"), "cluster_id").limit(k)


def bot_farms(engine: Engine, threshold: float = 0.95, least: int = 10, least_members: int = 3, k: int = 10) -> DataFrame:
    """Groups of authors with nearly the same daily rhythm as a leader; leaders in order of name, each author used once."""
    found = allpairs.rhythm_groups(engine.spark.sql(doubles(profile_hours(engine.dialect(), least))), threshold, least_members)
    return found.orderBy(F.desc("signals"), F.desc("n"), "leader").limit(k)


def identify_narratives(engine: Engine, days: float = 7, eps: float = 0.3, min_samples: int = 3, least: int = 5, k: int = 30, as_of: str | None = None) -> DataFrame:
    """Density clusters of recent posts: neighbours within ``eps`` cosine distance, core posts, components over core
    links, border posts with their nearest core.  Returns id, members, first and last time, and top words."""
    recent = engine.run("nv_recent_embeddings", as_of=as_of, days=days).select("id")
    vectors = stored(engine.tables["embs"].join(recent, F.col("content_id") == F.col("id"), "left_semi").select("content_id", "embedding"), "narrative-vectors")
    vectors.createOrReplaceTempView(view := f"recent_{uuid.uuid4().hex}")
    d = engine.dialect()
    kept = engine.spark.sql(doubles(theta_pairs(Spark({**d._relations, "embs": view}, d.now), 1 - eps)))
    both = stored(kept.select(F.col("id1").alias("x"), F.col("id2").alias("y"), "similarity").union(kept.select("id2", "id1", "similarity")), "narrative-near")
    core = both.groupBy("x").agg(F.count("*").alias("n")).filter(F.col("n") + 1 >= min_samples).select("x")
    links = both.join(core, "x", "left_semi").join(core.select(F.col("x").alias("y")), "y", "left_semi").filter("x < y")
    parts = graphs.connected(links.select(F.col("x").cast("string").alias("a"), F.col("y").cast("string").alias("b"))).select(F.col("author_name").cast("long").alias("id"), F.col("component").alias("part"))
    border = both.join(core, "x", "left_anti").join(parts.select(F.col("id").alias("y"), "part"), "y").groupBy(F.col("x").alias("id")).agg(F.max_by("part", F.struct("similarity", "part")).alias("part"))
    members = stored(parts.unionByName(border), "narrative-members")
    posts = engine.tables["posts"].select("id", "title", "content", "created_at")
    texts = members.join(posts, "id")
    sizes = texts.groupBy("part").agg(F.count("*").alias("posts"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")).filter(F.col("posts") >= least)
    stop = "'" + "','".join(insights_stop()) + "'"
    words = texts.selectExpr("part", r"explode(regexp_extract_all(lower(concat(coalesce(title, ''), ' ', coalesce(content, ''))), r'\b[a-z]{4,15}\b', 0)) as word").filter(f"word not in ({stop})")
    top = words.groupBy("part", "word").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "word"))).filter("r <= 5")
    key = top.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda s: s["word"]), ",").alias("key_words"))
    return sizes.join(key, "part").select(F.concat(F.lit("narrative_"), F.substring(F.md5("key_words"), 1, 8)).alias("narrative_id"), "posts", "first_seen", "last_seen", "key_words").orderBy(F.desc("posts"), "narrative_id").limit(k)


def insights_stop() -> list[str]:
    from .insights import STOP_WORDS

    return STOP_WORDS


def pushes(engine: Engine, hours: float = 2, least: int = 3, days: float = 7, k: int = 30, min_fingerprint: float = 0.7) -> DataFrame:
    """Pushes by falling score; one that begins inside a better one of its narrative is dropped.

    The score is authors by hour; authors whose fingerprints are alike on average raise it by that likeness.
    """
    d = engine.dialect()
    posts = stored(engine.query(lambda d: narrative_posts(d, days)), "push-posts")
    found = stored(allpairs.push_windows(posts, allpairs.fingerprint_rows(engine, d), int(hours * 3_600_000_000), least), "push-windows")
    base = F.col("authors") / (float(hours) + 0.1)
    raised = F.when(F.col("fingerprint") > min_fingerprint, 1 + F.col("fingerprint")).otherwise(F.lit(1.0))
    scored = found.select(
        "narrative_id", "post_id", "start_time", F.timestamp_micros("last_t").cast("timestamp_ntz").alias("end_time"), "authors", "posts",
        F.round("fingerprint", 3).alias("fingerprint_similarity"), F.round(base * raised, 2).alias("coordination_score"),
    )

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["coordination_score", "start_time", "post_id"], ascending=[False, True, True])
        out, taken = [], []
        for row in frame.itertuples(index=False):
            if not any(a <= row.start_time <= b for a, b in taken):
                taken.append((row.start_time, row.end_time))
                out.append(row)
        return pd.DataFrame(out, columns=frame.columns)

    first = stored(scored.groupBy("narrative_id").applyInPandas(keep, scored.schema).orderBy(F.desc("coordination_score"), "narrative_id", "start_time").limit(k), "push-first")
    a, b = first.alias("a"), posts.filter("author_name is not null").withColumnsRenamed({"post_id": "other", "start_time": "told"}).alias("b")
    inside = (F.col("b.told") <= F.col("a.end_time")) & ((F.col("b.told") > F.col("a.start_time")) | ((F.col("b.told") == F.col("a.start_time")) & (F.col("b.other") >= F.col("a.post_id"))))
    names = a.join(b, (F.col("a.narrative_id") == F.col("b.narrative_id")) & inside).groupBy("a.narrative_id", "a.post_id").agg(F.array_join(F.sort_array(F.collect_set("b.author_name")), ",").alias("members"))
    columns = [*first.columns[:4], "members", *first.columns[4:]]
    return first.join(names, ["narrative_id", "post_id"]).select(columns).orderBy(F.desc("coordination_score"), "narrative_id", "start_time")


# ---- machine learning ----------------------------------------------------------------------------------------


def encode(texts: DataFrame, text: str = "text", size: int = 64) -> DataFrame:
    """The default encoder: hashed term frequencies of words, of unit length, in built-in functions.

    Any other encoder is a function from DataFrame to DataFrame with the same columns.
    """
    words = texts.withColumn("word", F.explode(F.expr(rf"regexp_extract_all(lower({text}), r'[\p{{L}}]+', 0)")))
    slot = words.groupBy("content_id", F.pmod(F.xxhash64("word"), F.lit(size)).cast("int").alias("slot")).agg((F.log1p(F.count("*"))).alias("v"))
    rows = slot.groupBy("content_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("norm")).cast("float"))
    return rows.select("content_id", dense.alias("embedding"))


def generate_embeddings(engine: Engine, encoder: Callable[[DataFrame], DataFrame] = encode) -> DataFrame:
    """Vectors of posts and comments that have none yet: texts of over 10 (posts) or 5 characters, cut at 2000 or 1500."""
    done = engine.tables["embs"].select("content_id", "content_type")
    p = engine.tables["posts"].select(F.col("id").alias("content_id"), F.lit("post").alias("content_type"), F.trim(F.concat_ws(" ", "title", "content")).alias("text")).filter("length(text) > 10").withColumn("text", F.substring("text", 1, 2000))
    c = engine.tables["comments"].select(F.col("id").alias("content_id"), F.lit("comment").alias("content_type"), F.trim("content").alias("text")).filter("length(text) > 5").withColumn("text", F.substring("text", 1, 1500))
    fresh = p.unionByName(c).join(done, ["content_id", "content_type"], "left_anti")
    return encoder(fresh.select("content_id", "text")).join(fresh.select("content_id", "content_type"), "content_id")


def best_kmeans(rows: DataFrame, k: int, starts: int, seed: int = 42) -> DataFrame:
    """KMeans over ``features``, the best of several starts by cost."""
    rows = stored(rows, "kmeans-rows").withColumn("features", array_to_vector("v"))
    best = min((KMeans(k=k, seed=seed + i, featuresCol="features").fit(rows) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    centers = [c.tolist() for c in best.clusterCenters()]
    made = best.transform(rows).drop("features")
    at = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers]), F.col("prediction") + 1)
    far = F.sqrt(F.aggregate(F.zip_with("v", at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return made.withColumn("distance", far)


def content_clusters(engine: Engine, k: int = 10, starts: int = 10) -> DataFrame:
    """cluster and its posts, by KMeans over post vectors."""
    rows = engine.tables["embs"].filter("content_type = 'post'").select("content_id", F.col("embedding").cast("array<double>").alias("v"))
    return best_kmeans(rows, k, starts).select("content_id", F.col("prediction").alias("cluster"))


def dense_fingerprints(engine: Engine, least: int) -> DataFrame:
    """author_name and v, the 323 dimensions, of authors with enough activity."""
    rows = engine.spark.sql(fingerprints.whole(engine.dialect(), least))
    maps = rows.groupBy("author_name").agg(F.map_from_entries(F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), F.col("v").cast("double").alias("v")))).alias("m"))
    return maps.select("author_name", F.transform(F.sequence(F.lit(0), F.lit(322)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("v"))


def fingerprint_clusters(engine: Engine, k: int = 10, least: int = 5, starts: int = 3) -> DataFrame:
    """Clusters of authors: members, size and cohesion, one over one plus the mean distance to the centre."""
    rows = best_kmeans(dense_fingerprints(engine, least), k, starts)
    return rows.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("size"), (1 / (1 + F.avg("distance"))).alias("cohesion"), F.array_join(F.sort_array(F.collect_list("author_name")), ",").alias("members"))


def fingerprint_history(engine: Engine, least: int = 3) -> DataFrame:
    """What is appended to the history of fingerprints."""
    return dense_fingerprints(engine, least).select("author_name", F.col("v").cast("array<float>").alias("fingerprint"), F.lit(engine.as_of).alias("computed_at"), F.lit(1).alias("version"))


def latest_fingerprints(history: DataFrame) -> DataFrame:
    """The current fingerprint of each author: the last one wins."""
    return history.groupBy("author_name").agg(F.max_by("fingerprint", "computed_at").alias("fingerprint"), F.max("computed_at").alias("computed_at"))


def topic_matrix(engine: Engine, topics: int = 20, vocabulary: int = 5000, iterations: int = 10) -> DataFrame:
    """author_name, topic, label (three top words), share: LDA over each author's texts, all of them in each iteration; too few authors give no rows."""
    texts = engine.tables["activity"].filter("content is not null and author_name is not null")
    terms, rows, n = vocabulary_counts(texts.select("author_name", F.regexp_replace(F.lower("content"), r"[^\p{L}]+", " ").alias("text")), vocabulary)
    if n < 2 or not terms:
        return engine.spark.createDataFrame([], "author_name string, topic int, label string, share double")
    model = LDA(k=topics, maxIter=iterations, seed=42, optimizer="online", subsamplingRate=1.0).fit(rows)
    labels = ["_".join(terms[i] for i in places) for places in model.first_terms(3)]
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("topic") + 1)
    return model.shares(rows).select("author_name", "topic", label.alias("label"), "share")


def combined_matrix(engine: Engine, alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3, topics: DataFrame | None = None, above: float | None = None) -> DataFrame:
    """author1, author2, value: weighted cosines of interactions, rhythms and topics; ``topics`` (author_name, topic, share) is learned where it is not given; ``above``: only greater values."""
    topics = stored((topic_matrix(engine) if topics is None else topics).select("author_name", "topic", "share"), "combined-topics")
    topics.createOrReplaceTempView(view := f"topics_{uuid.uuid4().hex}")
    return allpairs.combined_pairs(engine, engine.dialect(), alpha, beta, gamma, view, above)


# ---- jobs ----------------------------------------------------------------------------------------------------


def run_each(engine: Engine, jobs: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """job, status, rows: each job runs by itself and a failure does not stop the others."""
    out = []
    for name, job in jobs.items():
        try:
            out.append((name, "ok", job().count()))
        except Exception as error:  # reported, not hidden
            out.append((name, f"failed: {str(error)[:200]}", None))
    return engine.spark.createDataFrame(out, "job string, status string, rows long")


def plans(engine: Engine, names: Iterable[str]) -> dict[str, Callable[[], DataFrame]]:
    return {name: (lambda name=name: engine.run(name)) for name in names}


def all_matrices(engine: Engine) -> DataFrame:
    return run_each(engine, plans(engine, ["mx_interaction", "mx_temporal", "mx_content_sim", "mx_combined"]))


def all_coordination(engine: Engine) -> DataFrame:
    return run_each(engine, {**plans(engine, ["co_sockpuppets", "co_vote_manip"]), "co_sync_posting": lambda: sync_posting(engine), "co_clusters": lambda: clusters(engine)})


def all_temporal(engine: Engine) -> DataFrame:
    return run_each(engine, {**plans(engine, ["tm_bursts", "tm_corr_pairs"]), "tm_bot_farm": lambda: bot_farms(engine)})


def all_narratives(engine: Engine) -> DataFrame:
    return run_each(engine, {"nv_identify": lambda: identify_narratives(engine), "nv_pushes": lambda: pushes(engine)})


def graded(found: DataFrame, kind: str, grades: list[tuple[Column, str]], confidence: Column) -> DataFrame:
    """Findings that reach a grade (condition, severity), the first that holds, as alerts."""
    severity = F.coalesce(*(F.when(condition, F.lit(name)) for condition, name in grades))
    return found.select(F.lit(kind).alias("alert_type"), *found.columns, severity.alias("severity"), F.round(confidence, 4).alias("confidence")).filter("severity is not null")


def sync_alerts(engine: Engine, low: float = 5, high: float = 10, **search: object) -> DataFrame:
    """From groups of synchronised posts."""
    score = F.col("score")
    found = sync_posting(engine, **search).select("seed", "authors", "n_posts", "similarity", "spread_minutes", "score")
    return graded(found, "synchronized_posting", [(score > high, "high"), (score > low, "medium")], F.least(score / 15, F.lit(1.0)))


def cluster_alerts(engine: Engine, low: float = 8, high: float = 12, **search: object) -> DataFrame:
    """From clusters of coordinated authors; the first 20 are named."""
    score = F.col("score")
    found = clusters(engine, **search).select("cluster_id", F.array_join(F.slice(F.split("members", ","), 1, 20), ",").alias("authors"), "n", "cohesion", "score")
    return graded(found, "coordination_cluster", [(score > high, "high"), (score > low, "medium")], F.least(score / 15, F.lit(1.0)))


def push_alerts(engine: Engine, critical: float = 10, high: float = 8, medium: float = 5, alike: float = 0.8, **search: object) -> DataFrame:
    """From coordinated pushes; critical only where the authors' fingerprints are alike too."""
    score, same = F.col("coordination_score"), F.coalesce("fingerprint_similarity", F.lit(0.0))
    found = pushes(engine, **search).select("narrative_id", "post_id", F.col("members").alias("authors"), "fingerprint_similarity", "coordination_score")
    return graded(found, "narrative_push", [((score > critical) & (same > alike), "critical"), (score > high, "high"), (score > medium, "medium")], F.least(score / 12, F.lit(1.0)))


def bot_farm_alerts(engine: Engine, **search: object) -> DataFrame:
    """From groups of like rhythms, by the number of their signals; the first 20 are named."""
    signals = F.col("signals")
    found = bot_farms(engine, **search).select("leader", F.array_join(F.slice(F.split("members", ","), 1, 20), ",").alias("authors"), "n", "signals")
    return graded(found, "bot_farm", [(signals >= 2, "high"), (signals >= 1, "medium")], F.least(signals / 3, F.lit(1.0)))


#: Rules over detectors; the others are plans of the same names.
DETECTED = {"al_sync": sync_alerts, "al_cluster": cluster_alerts, "al_push": push_alerts, "al_bot_farm": bot_farm_alerts}
ALERT_RULES = ("al_sockpuppet", "al_sync", "al_cluster", "al_burst", "al_push", "al_behavior", "al_bot_farm")


def all_alerts(engine: Engine, tests: dict[str, dict] | None = None) -> DataFrame:
    """rule, severity, alerts of the seven rules; fingerprints, which two rules read, are made once."""
    engine = Engine(engine.tables, engine.as_of)
    engine.prints = stored(allpairs.fingerprint_rows(engine, engine.dialect()), "alert-prints")
    out = []
    for rule in ALERT_RULES:  # one after the other, as one plan of all would have to lie in the driver whole
        params = (tests or {}).get(rule, {})
        found = DETECTED[rule](engine, **params) if rule in DETECTED else engine.run(rule, **params)
        out += [(rule, r["severity"], r["alerts"]) for r in found.groupBy("severity").agg(F.count("*").alias("alerts")).collect()]
    return engine.spark.createDataFrame(out, "rule string, severity string, alerts long")


def create_alerts(found: DataFrame, authors: str, kind: str, as_of: str) -> DataFrame:
    """Rows of the alert table from findings with severity and confidence; ``authors`` is a comma-separated column."""
    return found.select(
        F.xxhash64(F.lit(kind), authors).alias("id"), F.lit(kind).alias("alert_type"), "severity", F.split(authors, ",").alias("involved_authors"), "confidence", F.lit(as_of).cast("timestamp_ntz").alias("detected_at"), F.lit("active").alias("status")
    )


