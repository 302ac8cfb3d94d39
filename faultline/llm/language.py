"""Language identification by nearest centroid over TF-IDF n-grams.

A text is lower-cased, ASCII characters that are not letters become spaces, and its byte trigrams are counted in a
hashed space. Counts are damped by a logarithm, weighted by inverse document frequency and scaled to unit length.
Every language has a few centroids, found by spherical k-means over its own sample, so that a language written in
several manners is not averaged into one. The nearest centroid by cosine names the language; a text further from
it than any text of the sample, with a margin, is marked ``rejected``.

The fit reads at most ``SAMPLE_DOCS`` documents, dealt evenly to the languages (20 each at least, of the
``MOST_LANGUAGES`` with most documents) and picked by a hash of doc_id, none of them held out (crc32 of the id divisible
by 5). A doc_id that repeats counts once, with its least language and text. Scoring is row-wise without a shuffle: the
model has a fixed size per language.

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0 and not rejected; with
nothing to learn from every text is ``und``; a null doc_id is neither held out nor learned from; ties between
centroids go to the language first in code-point order; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_map

DIM, CENTROIDS, ROUNDS, SEED = 4096, 3, 12, 7
SAMPLE_DOCS, PER_LANGUAGE, MOST_LANGUAGES = 4000, 500, 1000
MARGIN, FOLDS = 1.25, 5
UNKNOWN = "und"
#: Letters by Unicode category; numerals that are no letters (fractions, circled digits) are none.
LETTER = regex.compile(r"\p{L}")
#: ASCII characters that are not small letters become spaces; bytes above stay.
TO_SPACE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
CHUNK_BYTES = 2_000_000


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Hashed byte-trigram counts, one row of ``DIM`` a text."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    begin, held, run = 0, 0, []

    def count() -> None:
        data = np.frombuffer(b"".join(run), dtype=np.uint8).astype(np.uint32)
        sizes = np.array([len(x) for x in run])
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        place = (code * np.uint32(2654435761)) >> np.uint32(20)
        owner = np.repeat(np.arange(len(run)), sizes)
        inside = owner[:-2] == owner[2:]
        inside &= data[1:-1] != 32
        flat = np.bincount(owner[:-2][inside] * DIM + place[inside], minlength=len(run) * DIM)
        out[begin : begin + len(run)] = flat.reshape(len(run), DIM)

    for i, text in enumerate(texts):
        data = b" " + (text or "").lower().encode().translate(TO_SPACE) + b" "
        if run and (held + len(data) > CHUNK_BYTES or len(run) >= 256):
            count()
            begin, held, run = i, 0, []
        run.append(data)
        held += len(data)
    if run:
        count()
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def cluster(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; begins with the row nearest the mean, then always with the row furthest from the chosen."""
    def unit(x):
        n = np.linalg.norm(x, axis=-1, keepdims=True)
        return x / np.where(n > 0, n, 1)

    chosen = [rows[int(np.argmax(rows @ unit(rows.mean(axis=0))))]]
    while len(chosen) < min(k, len(rows)):
        near = np.max(rows @ np.stack(chosen).T, axis=1)
        chosen.append(rows[int(np.argmin(near))])
    centres = np.stack(chosen)
    for _ in range(rounds):
        best = np.argmax(rows @ centres.T, axis=1)
        centres = np.stack([unit(rows[best == c].mean(axis=0)) if (best == c).any() else centres[c] for c in range(len(centres))])
    return centres


class Model:
    """Learned languages, their centroids and reaches."""

    def __init__(self, languages: list[str], owner: np.ndarray, centres: np.ndarray, reach: np.ndarray, idf: np.ndarray) -> None:
        self.languages, self.owner, self.centres, self.reach, self.idf = languages, owner, centres, reach, idf

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        written = [bool(t) and LETTER.search(t) is not None for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        near = weigh(trigram_counts([t if w else None for t, w in zip(texts, written, strict=True)]), self.idf) @ self.centres.T
        best = np.argmax(near, axis=1)
        score = np.clip(near[np.arange(len(texts)), best], 0, 1)
        far = 1 - score > self.reach[best]
        names = [self.languages[self.owner[b]] if w else UNKNOWN for b, w in zip(best, written, strict=True)]
        return names, [float(s) if w else 0.0 for s, w in zip(score, written, strict=True)], [bool(f) and w for f, w in zip(far, written, strict=True)]


def fit(samples: list[tuple[str, bytes]], centroids: int = CENTROIDS) -> Model:
    """A model from (language, trigram counts as float bytes) rows, in their order within a language."""
    samples = sorted(samples, key=lambda s: s[0])
    languages = sorted({s[0] for s in samples})
    if not samples:
        return Model([], np.zeros(0, int), np.zeros((0, DIM), np.float32), np.zeros(0), np.ones(DIM, np.float32))
    counts = np.stack([np.frombuffer(s[1], dtype=np.float32) for s in samples])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    rows = weigh(counts, idf).astype(np.float32)
    of = np.array([languages.index(s[0]) for s in samples])
    owner, centres, reach = [], [], []
    for i in range(len(languages)):
        own = rows[of == i]
        found = cluster(own, centroids).astype(np.float32)
        near = own @ found.T
        best = np.argmax(near, axis=1)
        far = 1 - near[np.arange(len(own)), best]
        for c in range(len(found)):
            owner.append(i)
            centres.append(found[c])
            reach.append(MARGIN * float(far[best == c].max()) if (best == c).any() else MARGIN * float(far.max()))
    return Model(languages, np.array(owner), np.stack(centres), np.array(reach), idf)


def learn(docs: DataFrame, id_name: str, text_name: str, lang_name: str, sample_docs: int = SAMPLE_DOCS, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on at most ``sample_docs`` documents (20 a language at least); what reaches the driver is their counts."""
    id_text = F.col(id_name).cast("string")
    learnable = docs.filter(F.col(lang_name).isNotNull() & F.col(text_name).isNotNull() & (F.crc32(id_text) % FOLDS != 0))
    ids = learnable.select(F.col(lang_name).cast("string").alias("lang"), F.col(id_name).alias("id"))
    sizes = {r.lang: r["count"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    quota = max(20, min(per_language, sample_docs // max(1, len(sizes))))
    # a hash lets through about twice the quota of each language, so that no task ranks a language half the rows share
    share = {lang: min(1 << 20, 2 * quota * (1 << 20) // n + 1) for lang, n in sizes.items()} or {"": 0}
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = ids.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < limit)
    chosen = chosen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= quota).select("id").distinct()
    # bounded by the sample, and one row an id however often it repeats
    pair = F.min(F.struct(F.col(lang_name).cast("string").alias("lang"), F.col(text_name).cast("string").alias("text")))
    picked = learnable.join(F.broadcast(chosen), F.col(id_name) == chosen["id"], "left_semi")
    picked = picked.groupBy(F.col(id_name).alias("id")).agg(pair.alias("p")).select("p.lang", "p.text")

    def make():
        return lambda texts: [[x.astype(np.float32).tobytes() for x in trigram_counts(texts)]]

    rows = text_map(picked, F.col("text"), [F.col("lang")], "counts binary", make).collect()
    return fit(sorted((r.lang, bytes(r.counts)) for r in rows))


def identify(docs: DataFrame, model: Model, id_name: str, text_name: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per document, from the text alone."""
    held = F.coalesce(F.crc32(F.col(id_name).cast("string")) % FOLDS == 0, F.lit(False))
    carry = [F.col(id_name).alias("doc_id"), held.alias("held_out")]
    return text_map(docs, F.col(text_name), carry, "lang_pred string, score double, rejected boolean", lambda: model.predict)


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs, "doc_id", "text", "lang"), "doc_id", "text")
