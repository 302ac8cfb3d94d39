"""Hard negatives, toxicity and whitening over small tables with every odd case, against plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import hard_negatives, toxicity, whitening

DDL = "vec_id long, embedding array<float>, label int, d int, x string, stored double"


def vectors(spark, n=240, d=6, seed=5, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(d) * spread], int(rng.integers(0, 4)), i, "x", 0.5) for i in range(n)]
    rows += [(n + j, rows[j][1], rows[j][2], 0, None, None) for j in range(8)]  # copies
    rows += [rows[50], rows[3]]  # repeated rows
    odd = [None, [], [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [0.0] * (d - 1) + [None], [1.0] * (d - 1), [2.0] * (d - 1), [0.0] * d, [3e38] * d]
    rows += [(1000 + 50 * i, v, 1, 0, "", 0.0) for i, v in enumerate(odd)]
    rows += [(None, rows[0][1], 1, 0, "", 0.0), (5000, rows[0][1], None, 0, "", 0.0)]
    return spark.createDataFrame(rows, DDL).repartition(5)


# ---- op11 ---------------------------------------------------------------------------------------------------


def brute_mine(rows):
    kept = set()
    for r in rows:
        v = r.embedding
        if r.vec_id is None or r.label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = tuple(int(np.floor(256 * float(c))) for c in v)
        if sum(c * c for c in x) < 1 << 56:
            kept.add((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, x))
    asks = {}
    for r in kept:
        if r[0] % 50 == 0:
            asks[r[0]] = min(asks.get(r[0], r), r, key=lambda a: (len(a[2]), a[1], np.array(a[2], np.int32).tobytes()))
    out = []
    for a in asks.values():
        scored = sorted((-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in kept if b[0] != a[0] and len(b[2]) == len(a[2]))
        for s, p in {(-s, i) for s, i, _ in [x for x in scored if x[2] == a[1]][:5]}:
            fits = [(-n, i) for n, i, label in scored if label != a[1] and 50 * s <= -100 * n <= 95 * s][:3]
            out += [(a[0], p, k + 1, i, s, n) for k, (n, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("spread,blocks", [(1.0, 1 << 20), (0.05, 1 << 10), (1e5, 1 << 11)])
def test_hard_negatives_against_brute_force(spark, spread, blocks):
    df = vectors(spark, spread=spread)
    label = hard_negatives.shifted_label(F.col("label").cast("long"), F.col("vec_id"))
    mine = hard_negatives.mine(df, label=label, query_bytes=blocks, vector_bytes=blocks)
    assert mine.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in mine.collect())
    assert found and found == brute_mine(df.collect())


def test_hard_negatives_of_empty_tables_and_lone_labels(spark):
    df = vectors(spark)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.filter("label = 2")).count() == 0  # no other label
    alone = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(alone).count() == 0  # no positive


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 8)) * 400
    v = np.concatenate([c + rng.standard_normal((200, 8)) * 10 for c in centres]).astype(np.int64)
    most = float((v * v).sum(axis=1).max())
    points = hard_negatives.augmented(v, most)
    pivots = hard_negatives.farthest_first(points, 6)
    stored = hard_negatives.distances(points, pivots)
    q = v[::40].astype(float)
    to_query = hard_negatives.distances(np.column_stack((q, np.zeros(len(q)))), pivots)
    base = most + (q * q).sum(axis=1)
    least, largest = hard_negatives.brackets(to_query, stored, stored, base)
    score = q @ v.T
    assert (least <= score).all() and (score <= largest).all()
    fifth = np.sort(score, axis=1)[:, -5]
    assert (largest >= fifth[:, None]).mean() < 0.7  # vectors in groups: some need no exact product


def test_products_stay_exact():
    a = np.array([[(1 << 27) - 1, (1 << 27) - 3]], dtype=np.int32)
    assert hard_negatives.products(a, a)[0, 0] == ((1 << 27) - 1) ** 2 + ((1 << 27) - 3) ** 2


# ---- op13 ---------------------------------------------------------------------------------------------------


def brute_whiten(rows, d):
    x = {}
    for i, r in enumerate(rows):
        v = r.embedding
        if v is not None and len(v) == d and all(c is not None and np.isfinite(c) and abs(c) < 2**31 / 64 for c in v):
            x[i] = np.array([int(np.floor(64 * float(c))) + 1_000_000 for c in v])
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], directions[:, ::-1]


def test_whitening_against_brute_force(spark):
    df = vectors(spark)
    rows = df.collect()
    out = whitening.whiten(df, components=4).collect()
    x, n, sums, values, directions = brute_whiten(rows, 6)
    by = {}
    for r in out:
        by.setdefault((r.vec_id, r.n), []).append(r)
    assert sum(len(v) for k, v in by.items() if k[1] == n) == 4 * len(x)
    for i, own in x.items():
        got = sorted({(r.component, r.whitened, r.deviation, r.explained) for r in by[(rows[i].vec_id, n)]})
        want = (own - sums / n) @ directions[:, :4] / np.sqrt(values[:4])
        for c, w, deviation, explained in got:
            assert deviation == int(((n * own - sums) ** 2).sum()) and abs(explained - values[c - 1] / values.sum()) < 1e-12
            assert min(abs(w - want[c - 1]), abs(w + want[c - 1])) < 1e-9
    # vectors of the other length are whitened among themselves: two of them lie on a line
    assert {(r.vec_id, r.component, r.n) for r in out if r.n != n} == {(1250, 1, 2), (1300, 1, 2)}
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9


def test_whitening_of_few_vectors(spark):
    df = vectors(spark)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 7")).count() == 0  # one vector has no variance
    assert {r.component for r in whitening.whiten(df.filter("vec_id in (7, 8, 9)")).collect()} == {1, 2}


def test_moments_merge_as_if_streamed_at_once():
    rng = np.random.default_rng(3)
    rows = (rng.integers(-50, 50, (500, 5)) + 1_000_000).astype(np.int64)
    whole = whitening.Moments.starting_at(rows[0])
    for block in np.array_split(rows, 7):
        whole.add(block)
    parts = []
    for block in np.array_split(rows, 4):
        parts.append(whitening.Moments.starting_at(block[0]))
        for row in block:  # one rank-one update at a time
            parts[-1].add(row[None, :])
    for p in parts[1:]:
        parts[0].merge(p)
    centred = rows - rows.mean(axis=0)
    for m in (whole, parts[0]):
        assert m.n == 500 and (m.sums + 500 * m.origin == rows.sum(axis=0)).all()
        assert np.allclose(m.covariance(), centred.T @ centred / 500, rtol=1e-12, atol=1e-10)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
def test_symmetric_qr(d):
    a = np.random.default_rng(d).standard_normal((d, d))
    for m in (a @ a.T, np.eye(d), np.zeros((d, d)), np.diag(np.arange(d, dtype=float)), np.ones((d, d))):
        values, vectors = whitening.symmetric_qr(m)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-12 * d * max(1, np.abs(m).max()))
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12) and np.allclose(vectors * values @ vectors.T, m, atol=1e-10)


def test_deviations_beyond_a_long_are_null():
    w = whitening.Whitener(1 << 31, np.zeros(2, np.int64), np.zeros(2, np.int64), np.zeros((2, 0)), np.zeros(0))
    assert w.deviations(np.array([[1, 1], [1, 0], [2, 0]], dtype=np.int64)) == [None, 1 << 62, None]


# ---- op12 ---------------------------------------------------------------------------------------------------

PLAIN = "river stone model paper garden window letter market winter summer table silver".split()


def tainted(r, i):
    words = [r.choice(PLAIN) + r.choice(["", "s", "ing", "ed"]) for _ in range(r.randint(8, 60))]
    toxic = i % 6 == 0
    if toxic and i % 4 == 0:
        for _ in range(3):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "Moron,", "scum", "pathetic!", "clown"]))
    elif toxic:
        for _ in range(4):
            words.insert(r.randrange(len(words)), "zorgu" + r.choice(["", "li", "nen", "ta", "ke"]))
    return " ".join(words), int(toxic)


@pytest.fixture(scope="module")
def rated(spark):
    r = random.Random(8)
    rows = [(i, *tainted(r, i)) for i in range(900)]
    docs = [(i, t, "en", 3, "n") for i, t, _ in rows] + [(None, "idiot", "en", 1, ""), (901, None, None, 0, ""), (902, "", "", 0, ""), rows[0][:2] + ("en", 1, "")]
    docs.append((903, "stone river " * 40_000 + "you worthless moron idiot", "en", 0, ""))
    labels = [(i, 1, x) for i, _, x in rows if i < 800] + [(5, None, None), (6, 1, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, votes int, toxic string").repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {i: x for i, _, x in rows},
    )


def test_toxicity_of_documents_never_learned_from(spark, rated):
    docs, labels, truth = rated
    model = toxicity.learn(docs, toxicity.ratings_of(labels))
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and set(out[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unseen = [(truth[r.doc_id], r.predicted) for r in out if r.doc_id in truth and (r.held_out or r.doc_id >= 800)]
    assert sum(a == b for a, b in unseen) / len(unseen) > 0.98 and {a for a, _ in unseen} == {0, 1}
    by = {r.doc_id: r for r in out}
    assert by[901].score == by[902].score < 0.5 and by[903].predicted == 1
    # no label of a held-out document reaches the model
    changed = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.learn(docs, toxicity.ratings_of(changed))
    assert np.allclose(again.weights, model.weights) and again.terms == model.terms


def test_toxicity_without_ratings(spark, rated):
    docs, labels, truth = rated
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, toxicity.ratings_of(labels.limit(0)))).collect()}
    english = [i for i, x in truth.items() if x and i % 4 == 0]
    assert np.mean([out[i].predicted for i in english]) > 0.9
    assert np.mean([out[i].predicted for i, x in truth.items() if not x]) < 0.02
    nothing = docs.limit(0)
    model = toxicity.learn(nothing, toxicity.ratings_of(labels))
    assert toxicity.score(nothing, model).count() == 0
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}


def test_label_model_finds_echoing_voters():
    rng = np.random.default_rng(4)
    m, n = len(toxicity.VOTERS), 40_000
    y = rng.random(n) < 0.2
    fires = rng.random((n, m)) < np.where(y[:, None], 0.6, 0.05)
    fires[:, 3] = np.where(rng.random(n) < 0.95, fires[:, 2], fires[:, 3])  # 3 echoes 2
    votes = (fires * (1 << np.arange(m))).sum(axis=1)
    model = toxicity.LabelModel.of(toxicity.sums_of(votes, y.astype(float), np.ones(n)))
    assert model.parent[3] == 2 or model.parent[2] == 3
    assert abs(model.prior - 0.2) < 0.01 and np.allclose(model.accuracy[1], 0.6, atol=0.03) and np.allclose(model.accuracy[0], 0.05, atol=0.02)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.99


def test_reader_against_plain_words():
    reader = toxicity.Reader(["=idiot/1", "^zorgu/2"])
    assert reader("zorguli only")[0] == [] and len(reader("zorguli zorgunen")[0]) == 1
    numbers, votes = reader('you "IDIOT", you')
    assert len(numbers) == 1
    for name in ("wits", "dense", "shouted insult", "addressed", "shouting"):
        assert votes & toxicity.BIT[name], name
    assert not votes & toxicity.BIT["several"] and reader(None) == ([], 0)
