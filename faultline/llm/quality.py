"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades. Labels give each rated document 0 (toxic), 1 (poor) or 2 (good). One weight vector over hashed text features
is shared by all grades; ordered thresholds split its score, ``P(grade >= k) = sigmoid(score - threshold_k)``. The
expected grade is the sum of those tails, and a document is selected when the tail of grade ``SELECT_GRADE`` reaches
``SELECT_TAIL``.

Features. The distinct words of a text (ASCII case and outer punctuation removed), hashed, each present or not; and
how often, in steps, its words carry odd signs, are shouted, hold no letter, or repeat the word before. Words that
fewer than ``MIN_DOCS`` documents of the fit hold, or whose documents' grades do not differ from the others' by
``SIGNIFICANT`` standard errors, have no weight: unseen and indifferent words are neutral in texts of any length.

The fit reads at most ``SAMPLE_DOCS`` rated documents, picked by a hash of doc_id and counted once each, as far as they
have ``SAMPLE_FEATURES`` features together. Where those are many, words are counted by grade and chosen on the
executors, and only the chosen ones reach the driver. Scoring is row-wise without a shuffle, with a model bounded by that sample.

Defined cases: a null text has no words, like an empty one, and gets what the thresholds alone say; several ratings of
a document count as the lowest; ratings with a null are left out; without ratings, or with one grade only, every
document is selected with tail 1; repeated rows are scored each; an empty table gives no rows; whole texts are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import discard, written
from .common import table, text_filter, text_map

BUCKETS = 1 << 24
SAMPLE_DOCS, MIN_DOCS, EPOCHS, BATCH, RATE, DECAY, SEED = 12_000, 6, 14, 256, 0.25, 2e-5, 11
#: Features of all documents of a fit together, four bytes each. From ``WHOLE_BELOW`` on, only chosen ones reach the driver.
SAMPLE_FEATURES, WHOLE_BELOW = 1 << 24, 1 << 20
GRADES, SELECT_GRADE, SELECT_TAIL = 3, 2, 0.5
SIGNIFICANT = 5.0
CACHE_ENTRIES = 150_000
STEPS = 8
#: Kinds of words whose share is a feature.
ODD, SHOUT, BARE, AGAIN = range(4)
OUTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ODD_BYTES = frozenset(b"#$%&*+<=>@\\^_`{|}~")


class _Numbers(dict):
    """word -> its place; ``new`` holds bucket and kind of the places since the last ``grown``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[tuple[int, int]] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        core = word.lower().strip(OUTER)
        odd = not ODD_BYTES.isdisjoint(word) or b"!!" in word
        shout = len(core) > 1 and word.isupper()
        self.new.append((zlib.crc32(core) % BUCKETS if core else -1, odd << ODD | shout << SHOUT | (not core) << BARE))
        return n


class Features:
    """texts -> (feature numbers end to end, where each text's begin); numbers from BUCKETS on are shares."""

    def __init__(self) -> None:
        self.number = _Numbers()
        self.known = np.zeros((1 << 12, 2), dtype=np.int32)  # bucket and kind by place
        self.filled = 0

    def grown(self) -> np.ndarray:
        """``known`` with the words met since."""
        new = self.number.new
        if new:
            end = self.filled + len(new)
            while end > len(self.known):
                self.known = np.concatenate((self.known, np.zeros_like(self.known)))
            self.known[self.filled : end] = new
            self.filled = end
            new.clear()
        return self.known

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > CACHE_ENTRIES:
            self.__init__()
        split = [t.encode().split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        look = self.number.__getitem__
        ids = np.fromiter((look(w) for words in split for w in words), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(split)), sizes)
        own_bucket, own_kind = self.grown()[ids].astype(np.int64).T
        again = np.zeros(len(ids), dtype=np.int64)
        again[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
        own_kind = own_kind | again << AGAIN
        wide = np.int64(BUCKETS + 4 * (STEPS + 1))
        has = own_bucket >= 0
        keys = [np.unique(owner[has] * wide + own_bucket[has])]
        for k in range(4):
            share = np.bincount(owner, weights=own_kind >> k & 1, minlength=len(split)) / np.maximum(sizes, 1)
            step = np.ceil(share * STEPS - 0.4).clip(0, STEPS).astype(np.int64)
            keys.append(np.arange(len(split)) * wide + BUCKETS + k * (STEPS + 1) + step)
        every = np.sort(np.concatenate(keys))
        return every % wide, np.searchsorted(every, np.arange(len(split)) * wide)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Feature numbers (ascending), their weights, and the thresholds of grades 1, 2, ..."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def tails(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as one row per text."""
        if not len(self.thresholds):
            return np.ones((len(starts), GRADES - 1))
        at = np.searchsorted(self.features, numbers).clip(0, max(len(self.features) - 1, 0))
        w = np.where(self.features[at] == numbers, self.weights[at], 0.0)
        score = np.add.reduceat(w, starts) if len(starts) else np.zeros(0)
        return sigmoid(score[:, None] - self.thresholds[None, :])


def told(counts: np.ndarray, by_grade: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Which features stay, by their documents of each grade (a row a feature) and all documents of each: a score test
    against thresholds alone, a word stays if its documents' grades differ from the rest's."""
    share = by_grade / by_grade.sum()
    pull = np.append(0, np.cumsum(share)[:-1]) - np.append(np.cumsum(share[::-1])[::-1][1:], 0)
    spread = float((share * (pull - (share * pull).sum()) ** 2).sum())
    docs = counts.sum(axis=1)
    return (np.abs(counts @ pull) >= SIGNIFICANT * np.sqrt(docs * max(spread, 1e-9))) & (docs >= MIN_DOCS) | (features >= BUCKETS)


def fit(numbers: list[np.ndarray], grades: np.ndarray) -> Model:
    """Maximum likelihood by Adagrad; thresholds are kept in order by a positive gap."""
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    features, place = np.unique(np.concatenate(numbers), return_inverse=True)
    own = np.repeat(grades, [len(x) for x in numbers])
    counts = np.bincount(place * GRADES + own, minlength=len(features) * GRADES).reshape(-1, GRADES)
    features = features[told(counts, np.bincount(grades, minlength=GRADES), features)]
    columns = [np.searchsorted(features, x[np.isin(x, features, assume_unique=True)]) for x in numbers]
    weights, seen = np.zeros(len(features)), np.full(len(features), 1e-6)
    theta = np.array([-2.0, *[0.7] * (GRADES - 2)])  # first threshold, then logarithms of the gaps
    theta_seen = np.full(len(theta), 1e-6)
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(len(columns))
        for begin in range(0, len(order), BATCH):
            some = order[begin : begin + BATCH]
            cols = np.concatenate([columns[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(columns[i]) for i in some])
            score = np.bincount(owner, weights=weights[cols], minlength=len(some))
            by_score, by_theta = slopes(score, grades[some], theta)
            grad = np.bincount(cols, weights=by_score[owner], minlength=len(features)) / len(some) + DECAY * weights
            seen += grad * grad
            weights -= RATE * grad / np.sqrt(seen)
            by_theta /= len(some)
            theta_seen += by_theta * by_theta
            theta -= RATE * by_theta / np.sqrt(theta_seen)
    return Model(features.astype(np.int64), weights, cuts_of(theta))


def cuts_of(theta: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, then positive gaps by their logarithms."""
    return np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))


def slopes(score: np.ndarray, grades: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the negative logarithm of P(grade), by each score and, summed over rows, by ``theta``."""
    cuts, most = cuts_of(theta), len(theta)
    upper = np.where(grades > 0, sigmoid(score - cuts[np.maximum(grades - 1, 0)]), 1.0)
    lower = np.where(grades < most, sigmoid(score - cuts[np.minimum(grades, most - 1)]), 0.0)
    p = np.maximum(upper - lower, 1e-9)
    by_cut = np.zeros(most)
    np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, upper * (1 - upper) / p, 0))
    np.add.at(by_cut, np.minimum(grades, most - 1), np.where(grades < most, -lower * (1 - lower) / p, 0))
    by_theta = np.cumsum(by_cut[::-1])[::-1].copy()
    by_theta[1:] *= np.exp(theta[1:])
    return upper + lower - 1, by_theta


def grades_of(labels: DataFrame, id_name: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(id, grade) with one row per rated document."""
    grade = F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).otherwise(2)
    rated = labels.filter(F.col(id_name).isNotNull() & F.col(quality).isNotNull() & F.col(toxic).isNotNull())
    return rated.groupBy(F.col(id_name).alias("id")).agg(F.min(grade).alias("grade"))


def learn(
    docs: DataFrame, graded: DataFrame, id_name: str = "doc_id", text_name: str = "text",
    sample_docs: int = SAMPLE_DOCS, sample_features: int = SAMPLE_FEATURES, whole_below: int = WHOLE_BELOW,
) -> Model:
    """Fits on the ``sample_docs`` rated documents that a hash of doc_id puts first, as far as they have
    ``sample_features`` features in all; one text an id, the least where it has several."""
    chosen = graded.orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = docs.select(F.col(id_name).alias("id"), F.col(text_name).cast("string").alias("text"))
    picked = texts.join(F.broadcast(chosen), "id")  # bounded by the sample
    picked = picked.groupBy("id").agg(F.min("grade").cast("long").alias("grade"), F.min("text").alias("text"))

    def make():
        features = Features()

        def numbers(texts):
            flat, starts = features(texts)
            return [[x.astype("<u4").tobytes() for x in np.split(flat, starts[1:])]]

        return numbers

    numbered = text_map(picked, F.col("text"), [F.col("id"), F.col("grade")], "numbers binary", make)
    numbered, at = written(numbered, "numbered")
    so_far = F.sum(F.length("numbers") / 4).over(Window.orderBy(F.xxhash64("id"), "id"))  # at most ``sample_docs`` rows, of a size each
    within = numbered.select("id", so_far.alias("n")).filter(F.col("n") <= sample_features).select("id")
    model = fit_on(numbered.join(F.broadcast(within), "id", "left_semi").select("id", "grade", "numbers"), whole_below)
    discard(docs.sparkSession, at)
    return model


def grade_counts(numbered: DataFrame) -> DataFrame:
    """feature, g0, g1, ...: how many documents of each grade have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grades, each = batch.column(0).to_numpy(), batch.column(1)
            flat = np.frombuffer(b"".join(each.to_pylist()), dtype="<u4")
            own = np.repeat(grades, pc.binary_length(each).to_numpy() // 4)
            met, n = np.unique(flat.astype(np.int64) * GRADES + own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(met // GRADES), *[pa.array(np.where(met % GRADES == g, n, 0)) for g in range(GRADES)]], names=["feature", *counted])

    counted = [f"g{g}" for g in range(GRADES)]
    met = numbered.select("grade", "numbers").mapInArrow(run, "feature long, " + ", ".join(f"{c} long" for c in counted))
    return met.groupBy("feature").agg(*[F.sum(c).alias(c) for c in counted])


def thinned(numbered: DataFrame, by_grade: np.ndarray) -> DataFrame:
    """(id, grade, numbers) with the chosen features only: ``fit`` chooses the same of all. They are counted and chosen
    where the rows are."""

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, *counts = (c.to_numpy() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(features[told(np.stack(counts, axis=1), by_grade, features)])], names=["feature"])

    features = np.sort(grade_counts(numbered).mapInArrow(choose, "feature long").toArrow().column(0).to_numpy()).astype("<u4")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(x, dtype="<u4") for x in batch.column(2).to_pylist()]
            out = [x[np.isin(x, features, assume_unique=True)].tobytes() for x in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "grade", "numbers"])

    return numbered.mapInArrow(run, numbered.schema)


def fit_on(numbered: DataFrame, whole_below: int = WHOLE_BELOW) -> Model:
    """The model of (id, grade, numbers) rows."""
    found = {r.grade: r for r in numbered.groupBy("grade").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("numbers") / 4).alias("n")).collect()}
    if len(found) > 1 and sum(r.n for r in found.values()) >= whole_below:
        numbered = thinned(numbered, np.array([found[g].docs if g in found else 0 for g in range(GRADES)]))
    rows = numbered.collect()
    if not rows:
        return fit([], np.zeros(0, np.int64))
    rows.sort(key=lambda r: r.id)
    return fit([np.frombuffer(r.numbers, dtype="<u4") for r in rows], np.array([r.grade for r in rows]))


def make_score(model: Model):
    """() -> (texts -> expected grade, tail of the selecting grade, kept)."""

    def make():
        features = Features()

        def score(texts):
            tails = model.tails(*features(texts))
            tail = tails[:, SELECT_GRADE - 1]
            return tails.sum(axis=1).tolist(), tail.tolist(), (tail >= SELECT_TAIL).tolist()

        return score

    return make


def rate(docs: DataFrame, model: Model, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail, kept: one row per document."""
    return text_map(docs, F.col(text_name), [F.col(id_name).alias("doc_id")], "expected_grade double, tail double, kept boolean", make_score(model))


def keep_selected(docs: DataFrame, model: Model, text_name: str = "text") -> DataFrame:
    """The rows that the classifier selects, with all their columns."""
    make = make_score(model)

    def verdicts():
        score = make()
        return lambda texts: score(texts)[2]

    return text_filter(docs, text_name, verdicts)


def learn_from(spark, sf_dir: str) -> Model:
    return learn(table(spark, sf_dir, "documents"), grades_of(table(spark, sf_dir, "labels")))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), learn_from(spark, sf_dir))
