"""Words counted in tasks against MLlib's counter, and topics learned by products of blocks against the plain loop."""

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F

from tideloom.operators import detectors, topics
from tideloom.plans.registry import Engine

from .test_operators import at, community

GROUPS = ["salt pepper sugar flour butter", "wheel engine brake clutch piston"]


def spoken(spark, authors=24, said=30):
    """Authors of one group of words each; all say the first words, and every text is long and repeats itself."""
    posts = [
        (i * said + j, "t", f"The AND Überall {' '.join(GROUPS[i % 2].split()[(j + m) % 5] for m in range(4))} x{j} no1{'' if i else ' allein'}", f"a{i}", "k", 1, 0, at(j))
        for i in range(authors) for j in range(said)
    ]
    return community(spark, [*posts, (9998, "t", None, "a0", "k", 1, 0, at(0)), (9999, "t", "12 - !", "silent", "k", 1, 0, at(0))], [(1, 0, "salt", None, 1, at(0))])


def texts(tables):
    spoken = tables["activity"].filter("content is not null and author_name is not null")
    return spoken.select("author_name", F.regexp_replace(F.lower("content"), r"[^\p{L}]+", " ").alias("text"))


@pytest.mark.parametrize("most", [1 << 19, 3])
def test_counts_are_those_of_the_counter(spark, monkeypatch, most):
    monkeypatch.setattr(topics, "MOST", most)
    tables = spoken(spark)
    joined = tables["activity"].filter("content is not null and author_name is not null").groupBy("author_name").agg(F.array_join(F.collect_list("content"), " ").alias("text"))
    words = StopWordsRemover(inputCol="all", outputCol="words").transform(RegexTokenizer(inputCol="text", outputCol="all", pattern=r"[^\p{L}]+", minTokenLength=2).transform(joined))
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=5000, minDF=2.0, maxDF=0.95).fit(words)
    want = {r["author_name"]: {counter.vocabulary[int(i)]: int(v) for i, v in zip(r["features"].indices, r["features"].values)} for r in counter.transform(words).collect()}
    names, rows, n = topics.vocabulary_counts(texts(tables), 5000)
    got = {r["author_name"]: {names[i]: v for i, v in zip(r["terms"], r["times"])} for r in rows.collect()}
    assert n == 25 and got == want and got["silent"] == {} and "überall" not in names


def test_more_candidates_where_the_frequent_ones_fail(spark):
    names, rows, _ = topics.vocabulary_counts(texts(spoken(spark)), 1)
    # the most frequent word is everybody's
    assert names[0] in " ".join(GROUPS) and rows.agg(F.max(F.size("terms"))).first()[0] == 1


def test_texts_are_not_kept_word_by_word(spark, monkeypatch):
    kept = []
    for module in (detectors, topics):
        monkeypatch.setattr(module, "stored", lambda df, tag, f=module.stored: kept.append(f(df, tag)) or kept[-1])
    tables = spoken(spark)
    detectors.topic_matrix(Engine(tables, "2024-01-03 00:00:00"), topics=2, iterations=2).count()
    cells = sum(frame.agg(F.coalesce(F.sum(F.size(name)), F.lit(0))).first()[0] for frame in kept for name, kind in frame.dtypes if kind in ("array<string>", "array<int>"))
    assert kept and cells < texts(tables).select(F.explode(F.split("text", " +"))).filter("length(col) >= 2").count() / 2


def test_learned_topics_part_the_groups(spark):
    got = detectors.topic_matrix(Engine(spoken(spark), "2024-01-03 00:00:00"), topics=2, iterations=60).toPandas()
    share = got.pivot(index="author_name", columns="topic", values="share")
    assert (share.loc["silent"] == 0).all() and np.allclose(share.drop("silent").sum(axis=1), 1)
    main = share.drop("silent").idxmax(axis=1)
    assert {len({main[f"a{i}"] for i in range(24) if i % 2 == g}) for g in (0, 1)} == {1} and main["a0"] != main["a1"]
    labels = got.drop_duplicates("topic").set_index("topic")["label"]
    assert all(set(labels[main[f"a{g}"]].split("_")) <= set(GROUPS[g].split()) for g in (0, 1))


def test_two_authors_have_topics(spark):
    posts = [(i, "t", f"common words {w}", w, "k", 1, 0, at(i)) for i, w in enumerate(["one", "two"])]
    got = detectors.topic_matrix(Engine(community(spark, posts, []), "2024-01-03 00:00:00"), topics=2).collect()
    assert {r["author_name"] for r in got} == {"one", "two"} and {*got[0]["label"].split("_")} == {"common", "words"}


def test_long_steps_end_where_plain_ones_do():
    rng = np.random.default_rng(1)
    words = rng.dirichlet(np.full(40, 0.1), 4)
    counts = np.stack([rng.multinomial(300, rng.dirichlet(np.full(4, 0.3)) @ words) for _ in range(50)]).astype(float)
    alpha = np.full(4, 0.25)
    plain = np.ones((50, 4))
    for _ in range(5000):
        theta = np.exp(topics.log_means(plain))
        plain = alpha + theta * ((counts / (theta @ words + 1e-100)) @ words.T)
    assert np.abs(topics.settled(counts, words, alpha, 1e-9) - plain).max() < 1e-4
    assert np.allclose(topics.digamma(np.array([0.05, 1.0, 30.0])), [-20.49784287, -0.57721566, 3.38443864], atol=1e-6)
    assert np.allclose(topics.trigamma(np.array([1.0, 30.0])), [1.64493407, 0.03389506], atol=1e-6)
