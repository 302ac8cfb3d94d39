"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier of its posteriors.

Terms. A word, without outer punctuation and in lower case, is a stem, and so are its first three to seven characters: an insult
that takes endings stays one stem. A term is a stem that one, two or three (or more) different words of a text share.

Voters. Each fires on a text or does not: five lexicons of insults by kind, in four languages; ``INDUCED`` lexicons dealt from
induced terms; and six patterns (two insults or more, dense insults, a shouted insult, an insult close to a form of
address, repeated exclamation marks, shouting). Induced terms cover the toxic rated documents of the sample: the one that
most documents without a term yet hold comes next, so words that copies of a document share are not taken for insults.

Label model. Toxic or clean is hidden; given it, each voter's firing depends on one other voter, the tree of these links
being the one of largest conditional mutual information, so that voters that echo each other count once. Accuracies (the
chances to fire on toxic and on clean texts) and the tree come from expectation maximisation over the counts of vote
patterns of all documents that are not held out. Rated documents of the sample are clamped to their rating and weigh as
much together as all others. The pattern table stays in the shared folder; each round collects sums of voter pairs only.

Classifier. Logistic regression over lexicon words and induced terms, fitted to the posteriors of the sample by Newton steps.
A text's score is the classifier's alone.

Sample. At most ``SAMPLE_DOCS`` rated documents that a hash of the id puts first, none held out (crc32 of the id divisible by
``FOLDS``), one of each text; candidates are at most ``MOST_TERMS`` terms held by ``MIN_DOCS`` documents or more that are rated
toxic more often by ``SIGNIFICANT`` standard errors, and in ``TELLING`` of them or more. Without ratings of both kinds, the
first documents of the hash take their place, unrated. Terms and the sample's term numbers are all that reaches the driver.

Defined cases: a null text has no words, like an empty one, and gets the classifier's base rate; several ratings of a document
count as toxic if one does, and null ratings not at all; of rows that share a doc_id the sample takes the least text; a null
doc_id is neither held out nor learned from; repeated rows are scored each; without any document to learn from every score
is 0; an empty table gives no rows; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard, written
from .common import table, text_map

FOLDS, SEED = 5, 77
SAMPLE_DOCS, MIN_DOCS, MOST_TERMS, SIGNIFICANT = 12_000, 4, 8192, 5.0
#: An induced term: at least this share of its documents is rated toxic, and that many of them hold no term before it beyond
#: ``CLEAN_COST`` for each clean one that holds it.
TELLING, COVERED, CLEAN_COST, MOST_INDUCED = 0.7, 2, 2, 512
INDUCED, ROUNDS = 12, 8
#: Insults per hundred words that are dense; words between an address and an insult.
DENSE, CLOSE = 2, 2
STEPS, RIDGE = 25, 0.02
PREFIXES, LEVELS = (3, 4, 5, 6, 7), 3
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…"

# Insults by kind, in English, Spanish, French and German, and forms of address.
LEXICONS = {
    "wits": "idiot idiots moron morons stupid dumb imbecile fool dimwit halfwit idiota imbécil estúpido tonto imbécile crétin débile dummkopf trottel schwachkopf",
    "worth": "worthless loser losers pathetic useless failure inútil perdedor patético nul minable raté versager nichtsnutz wertlos",
    "filth": "trash scum filth garbage vermin scumbag basura escoria ordure raclure pourriture abschaum dreck gesindel",
    "disgust": "disgusting revolting vile repulsive sickening gross asqueroso repugnante dégoûtant répugnant ekelhaft widerlich",
    "ridicule": "clown clowns joke freak creep jerk payaso bufón bouffon guignol witzfigur spinner",
}
SHOUTED = re.compile("[A-Z]{4}")
ADDRESS = "you your you're youre u tú usted eres vosotros tu vous es votre du ihr euch dein"

VOTERS = (*LEXICONS, *(f"induced {i}" for i in range(INDUCED)), "several", "dense", "shouted insult", "addressed", "exclaimed", "shouting")
BIT = {name: 1 << i for i, name in enumerate(VOTERS)}


# ---- terms and votes ----------------------------------------------------------------------------------------


def stems_of(word: str) -> list[str]:
    """A word's stems, the whole word first."""
    core = word.lower().strip(OUTER)
    return ["=" + core, *("^" + core[:n] for n in PREFIXES if len(core) > n)] if core else []


def term(stem: str, level: int = 1) -> str:
    return f"{stem}/{level}"


def sample_terms(texts: list[str | None]) -> list[list[str]]:
    """The terms of each text."""
    out = []
    for text in texts:
        shared = Counter(s for w in set((text or "").lower().split()) for s in stems_of(w))
        out.append([term(s, level) for s, n in shared.items() for level in range(1, min(n, LEVELS) + 1)])
    return out


def lexicon_bits() -> dict[str, int]:
    """The voters of each lexicon word, by its term."""
    bits: dict[str, int] = {}
    for name, words in LEXICONS.items():
        for w in words.split():
            own = term(stems_of(w)[0])
            bits[own] = bits.get(own, 0) | BIT[name]
    return bits


class Reader:
    """texts -> (numbers of the informative terms they hold, their votes as bits)."""

    def __init__(self, terms: list[str]) -> None:
        bits, number = lexicon_bits(), {t: i for i, t in enumerate(terms)}
        stems = sorted({t.rpartition("/")[0] for t in (*bits, *number)})
        # for each stem, by level: the number of the term, the bits of its voters
        self.at = [[self._level(number, bits, s, n) for n in range(1, LEVELS + 1)] for s in stems]
        self.whole = {s[1:]: i for i, s in enumerate(stems) if s[0] == "="}
        self.starts = {s[1:]: i for i, s in enumerate(stems) if s[0] == "^"}
        self.gate = frozenset(s[: PREFIXES[0]] for s in self.starts)
        self.address = frozenset(ADDRESS.split())

    @staticmethod
    def _level(number: dict[str, int], bits: dict[str, int], stem: str, level: int) -> tuple[int | None, int]:
        own = term(stem, level)
        return number.get(own), bits.get(own, BIT[f"induced {zlib.crc32(stem.encode()) % INDUCED}"] if own in number else 0)

    def __call__(self, text: str | None) -> tuple[list[int], int]:
        text = text or ""
        split = text.lower().split()
        whole, gate, first = self.whole, self.gate, PREFIXES[0]
        holders: dict[int, list[str]] = {}
        for w in set(split):
            core = w.strip(OUTER)
            if core in whole:
                holders.setdefault(whole[core], []).append(w)
            if core[:first] in gate:
                for n in PREFIXES:
                    if len(core) > n and core[:n] in self.starts:
                        holders.setdefault(self.starts[core[:n]], []).append(w)
        numbers: list[int] = []
        votes, insults = 0, set()
        for p, words in holders.items():
            for number, bits in self.at[p][: len(words)]:
                if number is not None:
                    numbers.append(number)
                if bits:
                    votes |= bits
                    insults.update(words)
        if insults:
            places = [i for i, w in enumerate(split) if w in insults]
            if len({w.strip(OUTER) for w in insults}) > 1:
                votes |= BIT["several"]
            if 100 * len(places) >= DENSE * len(split):
                votes |= BIT["dense"]
            if any(w.isupper() and w.lower() in insults for w in text.split()):
                votes |= BIT["shouted insult"]
            if any(w.strip(OUTER) in self.address for i in places for w in split[max(0, i - 1 - CLOSE) : i + 2 + CLOSE]):
                votes |= BIT["addressed"]
        if "!!" in text or "!?" in text:
            votes |= BIT["exclaimed"]
        return sorted(numbers), votes | (BIT["shouting"] if SHOUTED.search(text) else 0)


# ---- label model --------------------------------------------------------------------------------------------


def fired(votes: np.ndarray) -> np.ndarray:
    """Votes x voters, 1 where one fired."""
    return (votes[:, None] >> np.arange(len(VOTERS)) & 1).astype(np.float64)


def sums_of(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts by class: [class, i, j] of voters i and j firing together, [class, i, i] of i, and last of all rows."""
    fires = np.column_stack((fired(votes), np.ones(len(votes))))
    return np.stack([fires.T @ (fires * (weight * p)[:, None]) for p in (1 - toxic, toxic)])


@dataclass
class LabelModel:
    """``parent`` of each voter in the tree (-1 for its root), ``chance[class, voter, parent fired]`` to fire, prior."""

    prior: float
    parent: np.ndarray
    chance: np.ndarray
    accuracy: np.ndarray  # class x voter, whatever the parent does

    @classmethod
    def of(cls, sums: np.ndarray) -> LabelModel:
        m, rows = len(VOTERS), sums[:, -1, -1]
        total = max(rows.sum(), 1e-9)
        # one toxic and one clean document's worth of doubt, as a share of the whole
        doubt = total * 1e-4
        single = sums[:, np.arange(m), np.arange(m)]
        accuracy = (single + doubt * 0.5) / (rows[:, None] + doubt)
        together = sums[:, :m, :m]
        info = np.zeros((m, m))
        for c in (0, 1):
            n = rows[c] + doubt
            p = accuracy[c]
            both = (together[c] + doubt * np.outer(p, p)) / n
            for pij, pi, pj in (
                (both, p[:, None], p[None, :]), (p[:, None] - both, p[:, None], 1 - p[None, :]),
                (p[None, :] - both, 1 - p[:, None], p[None, :]), (1 - p[:, None] - p[None, :] + both, 1 - p[:, None], 1 - p[None, :]),
            ):
                q = np.maximum(pij, 1e-12)
                info += rows[c] / total * q * np.log(q / np.maximum(pi * pj, 1e-12))
        parent = spanning_tree(info)
        chance = np.zeros((2, m, 2))
        for j, i in enumerate(parent):
            on = together[:, i, j] if i >= 0 else single[:, j]
            of_parent = single[:, i] if i >= 0 else rows
            chance[:, j, 1] = (on + doubt * accuracy[:, j]) / (of_parent + doubt)
            chance[:, j, 0] = (single[:, j] - on + doubt * accuracy[:, j]) / (rows - of_parent + doubt)
        return cls(float(np.clip(rows[1] / total, 1e-6, 1 - 1e-6)), parent, np.clip(chance, 1e-6, 1 - 1e-6), accuracy)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        fires = fired(votes).astype(np.int64)
        above = np.where(self.parent >= 0, fires[:, self.parent], 1)
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(len(VOTERS)):
            p = self.chance[:, j][:, above[:, j]]
            p = np.where(fires[:, j], p, 1 - p)
            logit += np.log(p[1] / p[0])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def spanning_tree(info: np.ndarray) -> np.ndarray:
    """Parents in the spanning tree of largest total information, rooted at the first voter."""
    m = len(info)
    parent, best, inside = np.full(m, -1), info[0].copy(), np.zeros(m, bool)
    inside[0], nearest = True, np.zeros(m, np.int64)
    for _ in range(m - 1):
        j = int(np.where(inside, -np.inf, best).argmax())
        parent[j], inside[j] = nearest[j], True
        closer = ~inside & (info[j] > best)
        best[closer], nearest[closer] = info[j][closer], j
    return parent


def expected(patterns: DataFrame, model: LabelModel | None) -> np.ndarray:
    """``sums_of`` over the pattern table (votes, toxic or null, n); without a model, over its rated rows."""
    shape = (2, len(VOTERS) + 1, len(VOTERS) + 1)

    def run(batches):
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            votes, rated, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            known = np.isfinite(rated := rated.astype(np.float64))
            guess = np.where(known, rated, 0.0 if model is None else model.posterior(votes))
            total += sums_of(votes, guess, np.where(known | (model is not None), n, 0.0))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    rows = patterns.select("votes", "toxic", "n").mapInArrow(run, "sums binary").collect()
    return sum((np.frombuffer(r.sums).reshape(shape) for r in rows), np.zeros(shape))


def fit_label_model(patterns: DataFrame, rated: bool, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation. It starts from the rated rows, or from lexicons that are right more often than not."""
    if rated:
        model = LabelModel.of(expected(patterns, None))
    else:
        m = len(VOTERS)
        accuracy = np.full((2, m), 0.02)
        accuracy[1, [VOTERS.index(v) for v in (*LEXICONS, "several")]] = 0.5
        model = LabelModel(0.1, np.full(m, -1), np.repeat(accuracy[:, :, None], 2, axis=2), accuracy)
    for _ in range(rounds):
        model = LabelModel.of(expected(patterns, model))
    return model


# ---- classifier ---------------------------------------------------------------------------------------------


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    base: float | None
    labels: LabelModel | None = None

    def score(self, numbers: list[int]) -> float:
        if self.base is None:
            return 0.0
        x = self.base + (float(self.weights[numbers].sum()) if numbers else 0.0)
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def covering(numbers: list[np.ndarray], toxic: np.ndarray, terms: list[str]) -> list[int]:
    """Places of the candidates that lexicons list, and of those that cover the toxic documents which hold none of these."""
    listed = lexicon_bits()
    chosen = [i for i, t in enumerate(terms) if t in listed]
    owner = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    flat = np.concatenate(numbers) if len(owner) else np.zeros(0, np.int64)
    open_docs, wrong = toxic.astype(bool), CLEAN_COST * np.bincount(flat[toxic[owner] == 0], minlength=len(terms))
    open_docs[owner[np.isin(flat, chosen)]] = False
    while len(chosen) < MOST_INDUCED:
        gain = np.bincount(flat[open_docs[owner]], minlength=len(terms)) - wrong
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] < COVERED:
            break
        chosen.append(best)
        open_docs[owner[flat == best]] = False
    return sorted(chosen)


def fit_classifier(numbers: list[np.ndarray], posterior: np.ndarray, terms: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, base) of logistic regression on soft targets, by Newton steps with a ridge on the weights."""
    x = np.zeros((len(numbers), terms + 1), dtype=np.float32)
    x[:, -1] = 1
    for i, own in enumerate(numbers):
        x[i, own] = 1
    ridge = np.full(terms + 1, RIDGE)
    share = np.clip(posterior.mean(), 1e-6, 1 - 1e-6)
    w = np.zeros(terms + 1)
    w[-1] = np.log(share / (1 - share))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (p - posterior) + ridge * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None].astype(np.float32)).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


# ---- the operator -------------------------------------------------------------------------------------------


def ratings_of(labels: DataFrame, id_name: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """(id, toxic) with one row per rated document."""
    rated = labels.filter(F.col(id_name).isNotNull() & F.col(toxic).isNotNull())
    return rated.groupBy(F.col(id_name).alias("id")).agg(F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))


def _held(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _sample(docs: DataFrame, ratings: DataFrame, sample_docs: int) -> tuple[DataFrame, str, bool]:
    """(id, text, toxic) of the sample, written; where; and whether it is rated."""
    order = (F.xxhash64("id", F.lit(SEED)), F.col("id"))
    first = ratings.filter(~_held(F.col("id"))).orderBy(*order).limit(sample_docs)
    texts = docs.filter(F.col("id").isNotNull() & ~_held(F.col("id")))
    picked = texts.join(F.broadcast(first), "id")  # bounded by the sample
    one = picked.groupBy("id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    one = one.groupBy("text").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"))
    parts = min(64, docs.sparkSession.sparkContext.defaultParallelism)  # few rows, much to do for each
    rows, at = written(one.repartition(parts), "toxic-sample")
    kinds = rows.agg(F.count_distinct("toxic")).first()[0]
    if kinds > 1:
        return rows, at, True
    discard(docs.sparkSession, at)
    first = texts.groupBy("id").agg(F.min("text").alias("text")).orderBy(*order).limit(sample_docs)
    return *written(first.withColumn("toxic", F.lit(None).cast("int")).repartition(parts), "toxic-sample"), False


def _informative(sample: DataFrame) -> list:
    """Candidates for induced terms, as rows of one ``term``."""
    known = sample.agg(F.count("toxic"), F.sum("toxic")).first()
    share = known[1] / known[0]
    made = text_map(sample, F.col("text"), [F.col("toxic")], "terms array<string>", lambda: lambda texts: [sample_terms(texts)])
    counts = made.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    off = (F.col("hits") - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share)))
    told = counts.filter((F.col("n") >= MIN_DOCS) & (F.col("hits") >= TELLING * F.col("n"))).withColumn("z", off).filter(F.col("z") >= SIGNIFICANT)
    return told.orderBy(F.desc("z"), "term").limit(MOST_TERMS).select("term").collect()


def _read(terms: list[str]) -> Callable:
    def make():
        reader = Reader(terms)

        def read(texts):
            found = [reader(t) for t in texts]
            return [[n for n, _ in found], [v for _, v in found]]

        return read

    return make


def learn(docs: DataFrame, ratings: DataFrame, id_name: str = "doc_id", text_name: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_name).alias("id"), F.col(text_name).cast("string").alias("text"))
    sample, at, rated = _sample(docs, ratings, sample_docs)
    if rated:
        terms = sorted(r.term for r in _informative(sample))
        held = text_map(sample, F.col("text"), [F.col("id"), F.col("toxic")], "numbers array<long>, votes long", _read(terms)).collect()
        held.sort(key=lambda r: r.id)
        chosen = covering([np.array(r.numbers, dtype=np.int64) for r in held], np.array([r.toxic for r in held]), terms)
        terms = [terms[i] for i in chosen]
    else:  # the lexicons' own words are all there is
        terms = sorted(lexicon_bits())

    def votes():
        reader = Reader(terms)
        return lambda texts: [[reader(t)[1] for t in texts]]

    rows = text_map(sample, F.col("text"), [F.col("id"), F.col("toxic")], "numbers array<long>, votes long", _read(terms)).collect()
    if not rows:
        discard(spark, at)
        return Model(terms, np.zeros(len(terms)), None)
    rows.sort(key=lambda r: r.id)
    learnable = docs.filter(F.col("id").isNotNull() & ~_held(F.col("id")))
    counted = text_map(learnable, F.col("text"), [], "votes long", votes).groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    every, patterns_at = written(counted, "vote-patterns")
    total = every.agg(F.sum("n")).first()[0] or 0.0
    known = text_map(sample.filter("toxic is not null"), F.col("text"), [F.col("toxic")], "votes long", votes)
    known = known.groupBy("votes", "toxic").agg((F.count(F.lit(1)) * F.lit(total / len(rows))).alias("n"))
    patterns, all_at = written(every.select("votes", F.lit(None).cast("int").alias("toxic"), "n").unionByName(known), "vote-patterns")
    labels = fit_label_model(patterns, rated)
    posterior = labels.posterior(np.array([r.votes for r in rows], dtype=np.int64))
    weights, base = fit_classifier([np.array(r.numbers, dtype=np.int64) for r in rows], posterior, len(terms))
    discard(spark, at, patterns_at, all_at)
    return Model(terms, weights, base, labels)


def make_score(model: Model) -> Callable:
    def make():
        reader = Reader(model.terms)

        def score(texts):
            scores = [model.score(reader(t)[0]) for t in texts]
            return scores, [int(s >= 0.5) for s in scores]

        return score

    return make


def score(docs: DataFrame, model: Model, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document, from the text alone."""
    carry = [F.col(id_name).alias("doc_id"), _held(F.col(id_name)).alias("held_out")]
    return text_map(docs, F.col(text_name), carry, "score double, predicted int", make_score(model))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, ratings_of(table(spark, sf_dir, "labels"))))
