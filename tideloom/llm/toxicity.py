"""Toxicity (operator 8): votes of the nearest labelled examples by exact TF-IDF cosine.

Features of a text are all its lower-case words, and those word beginnings of four to eight letters that tell toxic
texts.  Texts and examples are TF-IDF vectors of unit length over every word of two texts or more of the labelled sample; features
that tell toxic texts by log-likelihood ratio weigh ``emphasis`` times as much.  The examples, ordered by length,
form an inverted index whose postings are cut in blocks, each with the largest weight in it (a block-max index).  A
query leaves the longest postings while their largest weights add up to less than ``least_cosine``, scores the others, and completes
each example whose score and the bounds of what was left reach that cosine; so it finds the exact k nearest of
that cosine or more (at the registered 0.3 and power 8 the votes of fifteen neighbours below it would move the mean by 2 % at most). Each neighbour votes with weight ``cosine ** power`` for its label;
votes are smoothed by the toxic share of the examples, and mapped to a calibrated
score by a monotone fit on the labelled sample (leaving each example out of its own vote).

The labelled sample is bounded: of each class at most ``max_examples`` rows in the order of a hash of doc_id, and of these
those that begin within the first ``max_chars`` characters.  That is the proven bound of what is broadcast: no more feature
entries than the sample has words.  Votes, base rate and calibration weigh each example by its class's
labelled rows over its examples, so that they keep the class mix of all labels.  Every row is scored, by its whole text.

Defined cases: null and empty texts and texts without a word of the sample get the toxic share of the examples, and texts
without a near example its calibrated value; ties of cosine go to the smaller example id; repeated rows are scored each and form one example; with no labelled
rows every score is 0; null labels and ids are not learned from; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .language import held_out

_WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64


def features(text: str) -> Counter[str]:
    """Counts of words and of word beginnings (marked by a final ``~``)."""
    out: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        out[word] += n
        for k in range(4, min(len(word), 9)):
            out[word[:k] + "~"] += n
    return out


def sample_labels(labels: DataFrame, max_examples: int) -> DataFrame:
    """doc_id, toxic and weight of at most ``max_examples`` rows of each class that are not held out.

    The weight of a row is the number of usable rows of its class over the number taken.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = usable.filter("toxic = 1").orderBy(*order).limit(max_examples).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(max_examples))
    sizes = usable.groupBy(F.col("toxic").alias("kind")).agg((F.greatest(F.count("*"), F.lit(max_examples)) / F.lit(max_examples)).alias("weight"))
    return taken.join(F.broadcast(sizes), F.col("toxic") == F.col("kind")).select("doc_id", "toxic", "weight")


def term_counts(sample: DataFrame) -> DataFrame:
    """term, toxic and clean: texts of each class that hold the term; summed in each task first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.blocks(batches):
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(common.texts_of(table), table.column("toxic").to_pylist()):
                for term in features(text):
                    counts.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["term", "toxic", "clean"])

    found = sample.select("text", "toxic").mapInArrow(common.tidied(run), "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(counts: DataFrame, n_toxic: int, n_clean: int, least_texts: int, least_gain: float, emphasis: float) -> dict[str, float]:
    """Every word of two texts of the sample or more, and the word beginnings that tell toxic texts, with their weights.

    A weight is the inverse document frequency, times ``emphasis`` for what tells toxic texts: in ``least_texts`` texts
    or more, twice as frequent in toxic ones, and of a log-likelihood ratio of ``least_gain`` (16 is one in 15,000 by chance).
    What reaches the driver is bounded by the sample's vocabulary.
    """
    n, n1, n0 = F.col("toxic") + F.col("clean"), F.lit(float(n_toxic)), F.lit(float(n_clean))
    rate = n / (n1 + n0)  # of texts with the term, if it told nothing
    p, q = F.col("toxic") / n1, F.col("clean") / n0

    def part(k, m, r):  # k of m texts hold the term; r: expected rate
        hit = F.when(k > 0, k * F.log(k / (m * r))).otherwise(0.0)
        return hit + F.when(m > k, (m - k) * F.log((m - k) / (m * (1 - r)))).otherwise(0.0)

    gain = 2 * (part(F.col("toxic").cast("double"), n1, rate) + part(F.col("clean").cast("double"), n0, rate))
    counts = counts.filter(n >= 2)
    tells = F.coalesce((n >= least_texts) & (n < n_toxic + n_clean) & (p > 2 * q) & (F.round(gain, 6) >= least_gain), F.lit(False))
    rows = counts.withColumn("tells", tells).filter(F.col("tells") | ~F.col("term").endswith("~")).orderBy("term").toArrow().to_pylist()
    telling = {t for t, _, _ in without_echoes([(r["term"], r["toxic"], r["clean"]) for r in rows if r["tells"]])}
    return {r["term"]: math.log(1 + (n_toxic + n_clean) / (r["toxic"] + r["clean"])) * (emphasis if r["term"] in telling else 1.0) for r in rows if r["term"] in telling or not r["term"].endswith("~")}


def without_echoes(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Drop the word beginnings that stand in the very texts of a longer term: the same counts and the same start."""
    longest: dict[tuple, tuple[str, int, int]] = {}
    for row in rows:
        key = (row[0][:4], row[1], row[2])
        if key not in longest or len(row[0]) - 2 * row[0].endswith("~") > len(longest[key][0]) - 2 * longest[key][0].endswith("~"):
            longest[key] = row
    kept = set(longest.values())
    return [row for row in rows if row in kept]


class Vectors:
    """TF-IDF vectors of unit length over weighted terms."""

    def __init__(self, terms: dict[str, float]):
        self.number = {t: i for i, t in enumerate(sorted(terms))}
        self.weights = np.array([terms[t] for t in sorted(terms)])
        # the word beginnings by their first four letters
        self.starts: dict[str, list[tuple[str, int]]] = {}
        for term, i in self.number.items():
            if term.endswith("~"):
                self.starts.setdefault(term[:4], []).append((term[:-1], i))

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        number, starts, found = self.number, self.starts, {}
        counts = Counter(_WORD.findall(text.lower()))
        for word in counts.keys() & number.keys():
            found[number[word]] = counts[word]
        for word in [w for w in counts if w[:4] in starts]:
            for start, i in starts[word[:4]]:
                if word.startswith(start) and word != start:
                    found[i] = found.get(i, 0) + counts[word]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        ids = np.fromiter(found, np.int64, len(found))
        order = np.argsort(ids)
        weights = (1 + np.log(np.fromiter(found.values(), np.float64, len(found))[order])) * self.weights[ids[order]]
        return ids[order], weights / math.sqrt(float(weights @ weights))


class BlockMaxIndex:
    """Inverted index of unit vectors with the block maxima of frequent terms; ``nearest`` is exact."""

    def __init__(self, n_terms: int, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(vectors)
        sizes = np.array([len(v[0]) for v in vectors], np.int64)
        # examples of like length stand together, so that the largest weights in a block are near the others
        self.example = np.argsort(sizes, kind="stable")
        self.place = np.argsort(self.example, kind="stable")
        self.ends = np.cumsum(sizes[self.example])
        self.terms = np.concatenate([vectors[i][0] for i in self.example]).astype(np.int32) if self.n else np.zeros(0, np.int32)
        self.weights = np.concatenate([vectors[i][1] for i in self.example]) if self.n else np.zeros(0)
        docs = np.repeat(np.arange(self.n, dtype=np.int32), sizes[self.example])
        order = np.argsort(self.terms, kind="stable")
        self.docs, self.by = docs[order], self.weights[order]
        self.bounds = np.searchsorted(self.terms[order], np.arange(n_terms + 1))
        # terms in more than a sixteenth of the examples: their largest weight in each block
        frequent = np.flatnonzero(np.diff(self.bounds) * 16 > self.n)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.block = np.arange(self.n) // BLOCK
        self.top = np.zeros(n_terms)
        np.maximum.at(self.top, self.terms, self.weights)
        self.largest = np.zeros((len(frequent), -(-self.n // BLOCK)))
        for row, term in enumerate(frequent.tolist()):
            some = slice(self.bounds[term], self.bounds[term + 1])
            np.maximum.at(self.largest[row], self.block[self.docs[some]], self.by[some])
        self.query = np.zeros(n_terms)

    def vector(self, no: int) -> tuple[np.ndarray, np.ndarray]:
        """The vector of an example."""
        place = self.place[no]
        some = slice(self.ends[place - 1] if place else 0, self.ends[place])
        return self.terms[some].astype(np.int64), self.weights[some]

    def _scores(self, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the given terms add to the cosine with each example, by place."""
        if not len(ids):
            return np.zeros(self.n)
        starts, ends = self.bounds[ids], self.bounds[ids + 1]
        lists = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist())]
        added = np.concatenate([self.by[some] for some in lists])
        added *= np.repeat(weights, ends - starts)
        return np.bincount(np.concatenate([self.docs[some] for some in lists]), added, self.n).astype(np.float64, copy=False)

    def _whole(self, places: np.ndarray) -> np.ndarray:
        """Cosines of the query with the examples at these places, by their whole vectors."""
        if not len(places):
            return np.zeros(0)
        starts, ends = np.where(places > 0, self.ends[places - 1], 0), self.ends[places]
        lists = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist())]
        added = self.query[np.concatenate([self.terms[some] for some in lists])]
        added *= np.concatenate([self.weights[some] for some in lists])
        return np.add.reduceat(added, np.cumsum(ends - starts) - (ends - starts))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples of a cosine above 0 and of ``least`` or more (all of them if fewer)."""
        if not len(ids) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        # the longest postings are left while all that they could add stays below the least cosine; the others are scored
        most = weights * self.top[ids]
        order = np.argsort(self.bounds[ids] - self.bounds[ids + 1], kind="stable")
        cut = int(np.searchsorted(np.cumsum(most[order]), 0.9 * least, side="right")) if least > 0 else 0
        left, scored = order[:cut], order[cut:]
        bound = self._scores(ids[scored], weights[scored])
        # what was left adds at most its largest weight in the block, or in the whole list
        rows = self.row[ids[left]]
        often = left[rows >= 0]
        bound += (weights[often] @ self.largest[self.row[ids[often]]])[self.block] + most[left[rows < 0]].sum()
        if skip >= 0:
            bound[self.place[skip]] = 0
        places = np.flatnonzero((bound >= least - 1e-9) & (bound > 0))
        self.query[ids] = weights
        cosine = self._whole(places)
        self.query[ids] = 0
        near = (cosine > 0) & (cosine >= least)
        if np.count_nonzero(near) > 8 * k:
            near &= cosine >= np.partition(cosine, len(cosine) - k)[len(cosine) - k] - 1e-9
        no, cosine = self.example[places[near]], cosine[near]
        first = np.lexsort((no, -np.round(cosine, 12)))[:k]
        return no[first], cosine[first]


class Voter:
    """A fitted model: terms, index, labels and calibration.  Its size is bounded by the sample's."""

    def __init__(self, terms: dict[str, float], examples: list[tuple[int, int, np.ndarray, np.ndarray]], k: int, power: float, class_weights: tuple[float, float] = (1.0, 1.0), least: float = 0.0):
        self.vectors = Vectors(terms)
        self.k, self.power, self.least = k, power, least
        # an example stands for as many labelled rows of its class as its weight (clean, toxic) says
        total = sum(class_weights[e[1]] for e in examples)
        self.base = sum(class_weights[1] for e in examples if e[1]) / total if examples else 0.0
        held = [e for e in examples if len(e[2])]
        self.ids = [e[0] for e in held]
        self.labels = np.array([e[1] for e in held], np.float64)
        self.stands_for = np.array([class_weights[e[1]] for e in held], np.float64)
        self.index = BlockMaxIndex(len(terms), [(e[2], e[3]) for e in held])
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def calibrate(self, raw: np.ndarray) -> None:
        """``raw``: the vote on each example of the index without itself."""
        if len(raw):
            self.knots, self.values = monotone(raw, self.labels, self.stands_for)

    def vote(self, ids: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        no, cosine = self.index.nearest(ids, weights, self.k, skip, self.least)
        if not len(no):
            return self.base, no, cosine
        by = np.maximum(cosine, 1e-9) ** self.power * self.stands_for[no]
        prior = 0.05
        return float((by @ self.labels[no] + prior * self.base) / (by.sum() + prior)), no, cosine

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        """Calibrated score, ids of the examples that decided, their cosines."""
        ids, weights = self.vectors.of(text)
        if not len(ids):
            return self.base, [], []
        raw, no, cosine = self.vote(ids, weights)
        value = float(np.interp(raw, self.knots, self.values))
        return min(1.0, max(0.0, value)), [self.ids[i] for i in no[:3]], cosine[:3].tolist()


def monotone(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of weighted y on x: knots and rising values.  Equal x (to nine digits) form one point."""
    points, which = np.unique(np.round(x, 9), return_inverse=True)
    total = np.bincount(which, weights, len(points))
    mean = np.bincount(which, weights * y, len(points)) / total
    pools: list[list[float]] = []  # weight, mean of y, mean of x
    for a, b, by in zip(points.tolist(), mean.tolist(), total.tolist()):
        pools.append([by, b, a])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w, m, c = pools.pop()
            v = pools[-1]
            t = v[0] + w
            pools[-1] = [t, (v[1] * v[0] + m * w) / t, (v[2] * v[0] + c * w) / t]
    return np.array([p[2] for p in pools]), np.array([p[1] for p in pools])


def sample_texts(docs: DataFrame, labels: DataFrame, max_examples: int, max_chars: int) -> tuple[DataFrame, dict[int, int], tuple[float, float]]:
    """The labelled sample with its texts, its rows by class, and the weight of a (clean, toxic) example."""
    chosen = common.stored(sample_labels(labels, max_examples), "toxicity-labels")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # at most 2 * max_examples rows of three numbers
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = common.stored(joined.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))), "toxicity-sample")
    taken = F.col("before") < max_chars
    found = placed.groupBy("toxic").agg(F.count(F.when(taken, 1)).alias("n"), (F.max("weight") * F.count("*") / F.count(F.when(taken, 1))).alias("weight")).collect()
    weight = {r["toxic"]: r["weight"] for r in found}
    return placed.filter(taken).drop("before"), {r["toxic"]: r["n"] for r in found}, (weight.get(0, 1.0), weight.get(1, 1.0))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 4_000, max_chars: int = 20_000_000, least_texts: int = 3, least_gain: float = 16.0, emphasis: float = 8.0, k: int = 15, power: float = 8.0, least_cosine: float = 0.3) -> Voter:
    """Fit on the bounded sample of labelled rows."""
    sample, n, weights = sample_texts(docs, labels, max_examples, max_chars)
    terms = choose_terms(term_counts(sample), n[1], n[0], least_texts, least_gain, emphasis) if n.get(1) and n.get(0) else {}
    context = docs.sparkSession.sparkContext
    shared_vectors = context.broadcast(Vectors(terms))

    def vectorise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared_vectors.value
        for table in common.blocks(batches):
            found = [vectors.of(t) for t in common.texts_of(table)]
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), table.column("toxic").combine_chunks(), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())],
                names=["doc_id", "toxic", "ids", "weights"],
            )

    # no more numbers than the sample has words
    made = sample.mapInArrow(common.tidied(vectorise), "doc_id long, toxic int, ids binary, weights binary").toArrow()
    rows = sorted(zip(*(made.column(c).to_pylist() for c in ("doc_id", "toxic", "ids", "weights"))))
    voter = Voter(terms, [(d, t, np.frombuffer(i, np.int64), np.frombuffer(w)) for d, t, i, w in rows], k, power, weights, least_cosine)
    shared = context.broadcast(voter)

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.vote(*model.index.vector(i), i)[0] for i in numbers], pa.float64())], names=["number", "raw"])

    # the votes on the examples are cast in tasks; one number for each comes back
    raw = np.zeros(len(voter.ids))
    numbers = docs.sparkSession.range(0, len(raw), 1, 32).withColumnRenamed("id", "number")
    for number, value in numbers.mapInArrow(common.tidied(vote), "number long, raw double").collect():
        raw[number] = value
    voter.calibrate(raw)
    return voter


def score(docs: DataFrame, voter: Voter) -> DataFrame:
    """doc_id, score, evidence (ids of the nearest examples) and their cosines for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(voter)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for table in common.blocks(batches):
            found = [model.score(t) for t in common.texts_of(table)]
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                names=["doc_id", "score", "evidence", "cosines"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(common.tidied(run), "doc_id long, score double, evidence array<long>, cosines array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence of every row."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "cosines")
