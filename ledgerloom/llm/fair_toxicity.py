"""Toxicity: a logistic classifier with counterfactual regularisation.

Features of a text are the distinct words (lower-cased, outer punctuation removed) and their distinct first four and five
letters, hashed to 32 bits. On a bounded sample of labelled rows (`max_rows` of each label, by a hash of doc_id) the
features with the strongest association with the label are kept (`max_features`), plus those of identity terms, and weights w are
fitted by minimising

    log loss + ridge |w|^2 + fairness x mean over pairs of (w . f(sentence) - w . f(counterfactual))^2

where a pair is a sentence of the sample with an identity term and the same sentence with that term swapped for another one of its
group; all such sentences count. So a mention of a group may not carry weight of its own, and neutral mentions are not taken for toxic ones.

The model has `max_features` weights at most and goes to the workers; texts are scored whole, in one pass, without a
shuffle. Labels are joined only by the bounded sample, which is broadcast.

Edge cases: a null or empty text has no features and gets the intercept's score; null labels or ids are not learned
from; a document labelled more than once is toxic if any label says so; without both labels in the sample every score is the
share of toxic rows (0 without rows); repeated rows are scored alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import prepare, stored, text_of

OUTER = ".,;:!?\"'()[]{}<>*#%&|/\\_-+=~`«»“”„’‘…"
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Groups of terms that may stand for each other in a sentence (a parameter; lower case, single words).
IDENTITY = (
    ("men", "women", "people", "girls", "boys"), ("man", "woman", "person", "girl", "boy"), ("he", "she", "they"),
    ("black", "white", "asian", "latino", "african", "european", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("immigrants", "foreigners", "refugees", "locals"), ("old", "young"), ("deaf", "blind", "disabled"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "einwanderer", "flüchtlinge"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "immigrés", "réfugiés"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "inmigrantes", "refugiados"),
)


def words_of(text: str) -> set[str]:
    return {w for w in (x.strip(OUTER) for x in set(text.lower().split())) if w}


def features_of_word(word: str) -> tuple[int, ...]:
    parts = {f"w {word}", f"5 {word[:5]}", f"4 {word[:4]}"} if len(word) > 3 else {f"w {word}"}
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in sorted(parts))


def features(text: str) -> set[int]:
    return {f for w in words_of(text) for f in features_of_word(w)}


def swaps(text: str, groups: tuple) -> Iterator[tuple[str, str]]:
    """Sentences with an identity term, each with the next term of the group in its place."""
    other = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    for sentence in SENTENCE.split(text):
        words = sentence.lower().split()
        swapped = [other.get(w.strip(OUTER), w) for w in words]
        if swapped != words:
            yield " ".join(words), " ".join(swapped)


@dataclass
class Model:
    index: dict[int, int]
    weights: np.ndarray
    intercept: float

    def scorer(self):
        """text -> score; words are looked up once for each worker's model."""
        index, weights, known = self.index, self.weights, {}

        def of(word: str) -> tuple[int, ...]:
            w = word.strip(OUTER)
            found = tuple(index[f] for f in features_of_word(w) if f in index) if w else ()
            if len(known) > 100_000:
                known.clear()
            known[word] = found
            return found

        def score(text: str) -> float:
            hit: set[int] = set()
            for w in set(text.lower().split()):
                f = known.get(w)
                if f is None:
                    f = of(w)
                if f:
                    hit.update(f)
            z = self.intercept + float(sum(weights[i] for i in sorted(hit)))
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def minimise(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, ridge: float, fairness: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Adam on the full batch; deterministic. A logistic fit of absent and present features, with swapped pairs held together."""
    size = np.array([len(r) for r in rows])
    own, at = np.repeat(np.arange(len(rows)), size), np.concatenate([np.array(r, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    sign, pair, pat = [], [], []
    for i, (a, b) in enumerate(pairs):
        for s, x in ((1.0, a), (-1.0, b)):
            sign += [s] * len(x)
            pair += [i] * len(x)
            pat += x
    sign, pair, pat = np.array(sign), np.array(pair, np.int64), np.array(pat, np.int64)
    share = labels.mean()
    w, b = np.zeros(n), float(np.log(share / (1 - share)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(own, w[at], len(rows))
        error = (1 / (1 + np.exp(-z)) - labels) / len(rows)
        g = np.bincount(at, error[own], n) + 2 * ridge * w
        if len(pairs):
            gap = np.bincount(pair, sign * w[pat], len(pairs))
            g += 2 * fairness / len(pairs) * np.bincount(pat, sign * gap[pair], n)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:n], b - move[n]
    return w, float(b)


def in_training(folds: int, held_fold: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != held_fold


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_fold: int = 2, max_rows: int = 15_000, max_features: int = 8192,
    groups: tuple = IDENTITY, ridge: float = 2e-6, fairness: float = 1.0,
) -> Model:
    """Learns from at most max_rows rows of each label; all else of the fit is bounded by that."""
    prepare(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(in_training(folds, held_fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    sample = [known.where(f"toxic = {y}").orderBy(*order).limit(max_rows) for y in (0, 1)]
    sample = F.broadcast(stored(spark, sample[0].union(sample[1]), "label-sample"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = stored(spark, slim.join(sample, "doc_id"), "labelled-texts")

    def present(batches):
        for batch in batches:
            toxic, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen: dict[int, list[int]] = {}
            for y, t in zip(toxic, texts):
                for f in features(t):
                    seen.setdefault(f, [0, 0])[y] += 1
            f = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array([seen[x][0] for x in f], pa.int64()), pa.array([seen[x][1] for x in f], pa.int64())], names=["f", "clean", "toxic"])

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model({}, np.zeros(0), float(np.log((share + 1e-12) / (1 - share + 1e-12))))
    counts = rows.select("toxic", "text").mapInArrow(present, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    strong = counts.where("clean + toxic >= 3").select("f", (F.abs(odds) * F.sqrt(F.greatest("clean", "toxic"))).alias("strength"), odds.alias("odds")).where("abs(odds) > 1")
    chosen = {r["f"] for r in strong.orderBy(F.desc("strength"), "f").limit(max_features).collect()}
    chosen |= {f for g in groups for t in g for f in features_of_word(t)}
    index = {f: i for i, f in enumerate(sorted(chosen))}

    def indexed(batches):
        for batch in batches:
            toxic, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = lambda t: sorted(index[f] for f in features(t) if f in index)
            found = [(y, at(t), [x for a, b in swaps(t, groups) for x in (at(a), at(b))]) for y, t in zip(toxic, texts)]
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["toxic", "at", "swapped"])

    data = rows.select("toxic", "text").mapInArrow(indexed, "toxic int, at array<int>, swapped array<array<int>>").toArrow().sort_by([("toxic", "ascending")])
    data = sorted(zip(*(data.column(c).to_pylist() for c in ("toxic", "at", "swapped"))))
    pairs = [(s[i], s[i + 1]) for _, _, s in data for i in range(0, len(s), 2)]
    w, b = minimise([r[1] for r in data], np.array([r[0] for r in data], float), pairs, len(index), ridge, fairness)
    used = {f: i for f, i in index.items() if abs(w[i]) > 1e-3}
    return Model(used, w, b)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): one row per row of docs."""
    prepare(spark)

    def run(batches):
        one = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 4, held_fold: int = 2, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs."""
    model = train(spark, docs, labels, folds=folds, held_fold=held_fold, **options)
    held = F.coalesce(~in_training(folds, held_fold), F.lit(False))
    return score(spark, docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns and in one pass."""
    model = train(spark, docs, labels, **options)
    prepare(spark)
    at = docs.columns.index("text")

    def run(batches):
        one = model.scorer()
        for batch in batches:
            keep = [one(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
