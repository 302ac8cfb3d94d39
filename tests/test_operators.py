"""Hand-computed cases of every operator group."""

import json
import math
import re
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline import api, rules, schemas
from faultline.functions import text, vectors
from faultline.operators import evaluation, evidence, graph, model, report, scoring, selection, taint, triage, vector_search, verdict

# ---- evidence -----------------------------------------------------------------------------------------------

LOG_DDL = "run_id long, sample_id long, ord int, exit_code int, stdout string, stderr string, timed_out boolean, expected_signals array<string>"
CASES = [
    (1, "", "==9==ERROR: AddressSanitizer: stack-buffer-overflow in row_copy", False, [], "CONFIRMED", 0.95, "asan", "CWE-121"),
    (0, "sum.c:4: runtime error: signed integer overflow while adding", "", False, [], "CONFIRMED", 0.90, "ubsan", "CWE-190"),
    (-11, "", "", False, [], "CONFIRMED", 0.9, "", ""),
    (134, "", "", False, [], "CONFIRMED", 0.9, "", ""),
    (1, "usage: tool FILE", "", False, [], "SUGGESTIVE", 0.3, "", ""),
    (-1, "", "", True, [], "NEUTRAL", 0.0, "", ""),
    (0, "all rows written", "", False, [], "SAFE", 1.0, "", ""),
    (0, "saw heap-use-after-free in the cache", "", False, ["heap-use-after-free"], "CONFIRMED", 0.95, "asan", "CWE-416"),
    (134, "", "*** stack smashing detected *** in head()", False, [], "CONFIRMED", 0.87, "crash", ""),
    (0, "", "Invalid read of size 2\nERROR SUMMARY: 7 errors", False, [], "CONFIRMED", 0.85, "valgrind", ""),
    (0, "", "definitely lost: 96 bytes\nERROR SUMMARY: 0 errors", False, [], "SUGGESTIVE", 0.6, "valgrind", "CWE-401"),
    (0, "", "Use of uninitialised value in sort\nERROR SUMMARY: 5 errors", False, [], "SUGGESTIVE", 0.6, "valgrind", "CWE-401"),
    (77, "", "MemorySanitizer: use-of-uninitialized-value in f", False, [], "CONFIRMED", 0.93, "msan", "CWE-457"),
    (66, "", "ThreadSanitizer: data race on counter", False, [], "CONFIRMED", 0.91, "tsan", "CWE-362"),
    (1, "", "PANIC while closing", False, [], "SUGGESTIVE", 0.5, "", ""),
    (-11, "", "AddressSanitizer: SEGV on unknown address 0x08\nSegmentation fault", False, [], "CONFIRMED", 1.0, "asan", ""),
    (133, "", "Trace/breakpoint trap at start", False, [], "CONFIRMED", 0.87, "crash", ""),
    (0, "", "runtime error: index 31 out of bounds", False, [], "CONFIRMED", 0.90, "ubsan", ""),
    (0, "Stale HANDLE", None, False, ["stale handle"], "CONFIRMED", 0.85, "", ""),
    (0, "fatal", "", False, None, "NEUTRAL", 0.0, "", ""),
    (139, "", "", True, [], "CONFIRMED", 0.9, "", ""),
    (5, None, None, None, None, "SUGGESTIVE", 0.3, "", ""),
]


def test_evidence_ladder(spark):
    rows = [(i, 1, i, *c[:5]) for i, c in enumerate(CASES)]
    out = evidence.classify(spark.createDataFrame(rows, LOG_DDL)).orderBy("run_id").collect()
    assert [(r.level, r.confidence, r.sanitizer_source, r.cwe_id) for r in out] == [c[5:] for c in CASES]
    assert out[11].valgrind_errors == 5 and out[2].matched_patterns == ["SIGSEGV"]
    assert evidence.classify(spark.createDataFrame([], LOG_DDL)).count() == 0


def test_expectations(spark):
    got = evidence.expectations(spark.createDataFrame([("race_condition",), ("other",), (None,)], "vuln_type string")).collect()
    assert [(r.sanitizers, r.expected_signals) for r in got] == [("thread", ["ThreadSanitizer", "data race"]), ("", []), ("", [])]


def test_asan_report(spark):
    log = "ERROR: AddressSanitizer: heap-buffer-overflow in rows\nWRITE of size 16 at 0x7e00aa10 thread T2\n#0 0x51a2f0 in fill /src/fill.c:8\n#1 0x51b004 in work /src/work.c:77\n"
    r = evidence.classify(spark.createDataFrame([(1, 1, 0, 1, log, "", False, []), (2, 1, 1, -11, "", "", False, [])], LOG_DDL)).orderBy("run_id").collect()
    a = r[0].asan_report
    assert (a.error_type, a.access_type, a.access_size, a.address) == ("heap-buffer-overflow", "WRITE", 16, "0x7e00aa10")
    assert a.stack_frames == ["#0 fill (/src/fill.c:8)", "#1 work (/src/work.c:77)"] and r[1].asan_report is None


def test_early_stop_is_a_prefix(spark):
    rows = [(1, 0, "SAFE"), (1, 1, "CONFIRMED"), (1, 2, "SAFE"), (2, 0, "SAFE"), (2, 1, "NEUTRAL"), (3, 0, "CONFIRMED"), (3, 1, "CONFIRMED")]
    out = evidence.until_first(spark.createDataFrame(rows, "g long, o int, level string"), "g", "o", F.col("level") == "CONFIRMED")
    assert sorted((r.g, r.o) for r in out.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]


def test_execution_log(spark):
    raw = [
        (1, 0, "===COMPILATION_OK===\nEXIT_CODE=139\n===VALGRIND_START===\nInvalid read of size 4\n===VALGRIND_END===", "oops"),
        (2, 1, "error: expected ';'", None),
    ]
    a, b = evidence.execution_log(spark.createDataFrame(raw, "run_id long, returncode int, stdout string, stderr string")).orderBy("run_id").collect()
    assert (a.exit_code, a.compiled, a.valgrind_output, a.stderr, a.compilation_error) == (139, True, "Invalid read of size 4", "oops\nInvalid read of size 4", "")
    assert (b.exit_code, b.compiled, b.compilation_error) == (1, False, "error: expected ';'\n")


def test_profiles_default(spark):
    kinds = spark.createDataFrame([("double_free",), ("toctou",), ("integer_overflow",)], "vuln_type string")
    assert {r.vuln_type: r.profile for r in evidence.profiles(kinds).collect()} == {"double_free": "asan_ubsan", "toctou": "tsan", "integer_overflow": "asan_ubsan"}


def test_cut_outputs_and_cap(spark):
    df = spark.createDataFrame([(1, i, "x" * 20_000, None) for i in range(5)], "g long, o int, stdout string, stderr string")
    assert {len(r.stdout) for r in evidence.cut_outputs(df).collect()} == {rules.MAX_OUTPUT}
    assert [r.o for r in evidence.cap(df, "g", [F.col("o")], 3).orderBy("o").collect()] == [0, 1, 2]


# ---- verdicts -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("h", "level", "conf", "review", "review_conf", "want", "confidence"),
    [
        (0.3, None, 0, None, 0, "SAFE", 0.7), (0.9, "CONFIRMED", 0.95, None, 0, "CONFIRMED", 0.925), (0.9, "SUGGESTIVE", 0.5, None, 0, "SUGGESTIVE", 0.81),
        (0.9, "SAFE", 1.0, None, 0, "NEUTRAL", 0.63), (0.8, None, 0, None, 0, "SUGGESTIVE", 0.8), (0.6, None, 0, None, 0, "NEUTRAL", 0.6),
        (0.75, None, 0, None, 0, "SUGGESTIVE", 0.75), (0.9, "SUGGESTIVE", 0.5, "false_positive", 0.8, "NEUTRAL", 0.486), (0.6, "SAFE", 1.0, "true_positive", 0.8, "SUGGESTIVE", 0.7),
        (0.6, "SAFE", 1.0, "false_positive", 0.9, "SAFE", 0.5), (0.9, "CONFIRMED", 0.95, "true_positive", 0.9, "CONFIRMED", 0.9125), (0.8, None, 0, "uncertain", 0.5, "SUGGESTIVE", 0.56),
        (0.5, None, 0, None, 0, "NEUTRAL", 0.5),
    ],
)
def test_verdict(spark, h, level, conf, review, review_conf, want, confidence):
    e = [(1, 0, level, conf, "", "")] if level else []
    proof = spark.createDataFrame(e, "sample_id long, ord int, evidence_level string, confidence double, cwe_id string, sanitizer_source string")
    said = spark.createDataFrame([(1, review, float(review_conf))] if review else [], "sample_id long, verdict string, confidence double")
    r = verdict.fuse(spark.createDataFrame([(1, h)], "sample_id long, hybrid_score double"), evidence.rollup(proof), said).first()
    assert r.verdict == want and math.isclose(r.confidence, confidence)


def test_confirmed_without_a_stated_confidence(spark):
    proof = spark.createDataFrame([(1, 0, "CONFIRMED", None, "", "")], "sample_id long, ord int, evidence_level string, confidence double, cwe_id string, sanitizer_source string")
    none = spark.createDataFrame([], "sample_id long, verdict string, confidence double")
    r = verdict.fuse(spark.createDataFrame([(1, 0.8)], "sample_id long, hybrid_score double"), evidence.rollup(proof), none).first()
    assert r.verdict == "CONFIRMED" and math.isclose(r.confidence, 0.5 * 0.8 + 0.5 * 0.9)


def test_dry_run(spark):
    assert verdict.dry_run(spark.createDataFrame([(1,)], "x int")).first().evidence_level == "NEUTRAL"


# ---- votes and scores ---------------------------------------------------------------------------------------


def neighbours(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, label int, vuln_type string")


def test_majority_and_fraction(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "vec_id long")
    n = neighbours(spark, [(1, 1, 1, "b"), (1, 2, 1, "a"), (1, 3, 1, "a"), (1, 4, 1, "b"), (1, 5, 0, "c"), (2, 1, 0, "a")])
    got = {r.query_id: (r.vuln_type, r.confidence) for r in vector_search.majority_type(n, q).collect()}
    assert got == {1: ("b", 0.5), 2: ("unknown", 0.0), 3: ("unknown", 0.0)}
    assert {r.query_id: r.faiss_score for r in vector_search.label_fraction(n, q).collect()} == {1: 0.8, 2: 0.0, 3: 0.5}


def test_top_k_over_blocks_and_ties(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((120, 8))
    v[7] = v[3] * 2
    v[11] = 0
    df = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    sims = unit @ unit.T
    got = vector_search.top_k(df, df, 4, query_bytes=1000, vector_bytes=1500).collect()
    for i in range(120):
        want = sorted((j for j in range(120) if j != i), key=lambda j: (-round(sims[i, j], 12), j))[:4]
        assert [x.neighbour_id for x in sorted((x for x in got if x.query_id == i), key=lambda x: x.rank)] == want


def test_retrieval_filters_after_ranking(spark):
    near = neighbours(spark, [(1, i, 1, "x" if i % 4 == 0 else "y") for i in range(1, 16)])
    assert [(r["rank"]) for r in vector_search.retrieve(near, F.col("vuln_type") == "x", 5).collect()] == [1, 2, 3]


def test_scores(spark):
    df = spark.createDataFrame([(0.9, 0.2, 1), (0.1, 0.9, 1), (0.5, 0.5, 0), (0.8, None, 1)], "cls_prob double, faiss_score double, label int")
    got = [r.h for r in df.select(scoring.hybrid(F.col("cls_prob"), F.col("faiss_score")).alias("h")).collect()]
    assert got == pytest.approx([0.62, 0.42, 0.5, 0.8])
    at = spark.createDataFrame([(0.5,)], "s double").select(scoring.predicted(F.col("s")).alias("p"), scoring.below_threshold(F.col("s")).alias("b")).first()
    assert (at.p, at.b) == (0, False)
    grid = spark.createDataFrame([(0.2, 0.7), (0.1, 0.7), (0.9, 0.5)], "beta double, accuracy double")
    assert scoring.best_beta(grid).first().beta == 0.1


def test_normalize(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(vectors.normalize(F.col("a")).alias("a"), vectors.normalize(F.col("b")).alias("b")).first()
    assert r.a == [0.6, 0.8] and r.b == [0.0, 0.0]


# ---- evaluation ---------------------------------------------------------------------------------------------


def counts(spark, *c):
    return evaluation.rates(spark.createDataFrame([c], "tp long, tn long, fp long, fn long")).first()


def test_rates(spark):
    assert counts(spark, 40, 30, 20, 10).accuracy == 0.7
    r = counts(spark, 40, 0, 10, 10)
    assert (r.precision, r.recall) == (0.8, 0.8) and math.isclose(r.f1, 0.8)
    assert tuple(counts(spark, 0, 0, 0, 0))[4:] == (0.0, 0.0, 0.0, 0.0)


def test_times_and_reduction(spark):
    t = evaluation.time_stats(spark.createDataFrame([(float(i),) for i in range(1, 5)], "s double"), "s").first()
    assert (t.avg_time, t.median_time) == (2.5, 2.5)
    rows = [(0, 1, int(i >= 60)) for i in range(100)] + [(1, 1, 1)]
    r = evaluation.fp_reduction(spark.createDataFrame(rows, "label int, before int, after int"), "before", "after").first()
    assert math.isclose(r.fp_reduction, 0.6)
    assert evaluation.exploitation_rate(spark.createDataFrame([(50, 30)], "t int, c int"), "t", "c").first()[0] == 0.6


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [2.0, 2.0, 2.0, 5.0], [float(i * 7 % 31) for i in range(200)], [float(i * i) for i in range(101)], [1.0] * 50 + [9.0] * 50])
def test_median_by_ranges(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    found = evaluation.median(df, "v")
    assert found.first().median == (statistics.median(values) if values else None)
    assert "percentile" not in found._jdf.queryExecution().toString().lower()


def test_summary_has_all_keys(spark):
    rows = [(1, 1, 1, 3, 1, 0.5), (0, 0, 1, 2, 0, 1.5), (1, 0, 1, 0, 0, 2.0), (0, 1, 0, 1, 1, 4.0)]
    df = spark.createDataFrame(rows, "prediction int, label int, before int, tried long, confirmed long, seconds double")
    r = evaluation.summary(df, "sandbox-only", before="before", tried="tried", confirmed="confirmed", seconds="seconds").first().asDict()
    assert r == {
        "mode": "sandbox-only", "total": 4, "accuracy": 0.5, "precision": 0.5, "recall": 0.5, "f1": 0.5, "true_positives": 1, "true_negatives": 1,
        "false_positives": 1, "false_negatives": 1, "fp_reduction": 0.5, "exploitation_rate": 1 / 3, "avg_time": 2.0, "median_time": 1.75,
    }
    r = evaluation.summary(df.limit(0)).first()
    assert (r.total, r.accuracy, r.fp_reduction, r.exploitation_rate, r.median_time) == (0, 0.0, 0.0, 0.0, 0.0)


def test_auc(spark):
    r = np.random.default_rng(3)
    rows = [(float(r.integers(0, 20)), int(r.integers(0, 2))) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "score double, label int")
    assert math.isclose(evaluation.roc_auc(df).first().auc, want)
    assert evaluation.roc_auc(df.filter("label = 1")).first().auc == 0.0


def test_losses(spark):
    r = np.random.default_rng(5)
    v = r.standard_normal((10, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = np.array([0, 1, 0, 1, 1, 0, 0, 1, 0, 2])
    df = spark.createDataFrame([(i, 0, [float(x) for x in u], int(k)) for i, (u, k) in enumerate(zip(v, y, strict=True))], "i long, b long, v array<double>, y int")
    pairs = evaluation.batch_pairs(df, "b", "i", "v", "y")
    sim = v @ v.T / 0.07
    own = []
    for i in range(10):
        others = [j for j in range(10) if j != i]
        positive = [j for j in others if y[j] == y[i]]
        if positive:
            own.append(np.log(np.exp(sim[i, others]).sum()) - sim[i, positive].mean())
    assert math.isclose(evaluation.supervised_contrastive(pairs).first().loss, np.mean(own), rel_tol=1e-9)
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    own = []
    for i in range(10):
        p, n = [d[i, j] for j in range(10) if j != i and y[j] == y[i]], [d[i, j] for j in range(10) if y[j] != y[i]]
        if p and n:
            own.append(max(0, max(p) - min(n) + 0.3))
    assert math.isclose(evaluation.hard_triplet(pairs).first().loss, np.mean(own), rel_tol=1e-6)


# ---- graphs -------------------------------------------------------------------------------------------------


def sliding(tokens, w):
    windows = [tokens] if len(tokens) <= w else [tokens[i : i + w] for i in range(len(tokens) - w + 1)]
    out = {}
    for x in windows:
        for p in range(len(x)):
            for q in range(p):
                if x[p] != x[q]:
                    for e in ((x[p], x[q]), (x[q], x[p])):
                        out[e] = out.get(e, 0) + 1
    return out


@pytest.mark.parametrize("w", [2, 3, 4])
def test_edges_against_sliding_windows(spark, w):
    r = np.random.default_rng(w)
    docs = [(i, [str(x) for x in r.integers(0, 5, n)]) for i, n in enumerate([0, 1, 2, 3, 4, 9, 30])] + [(7, None)]
    df = spark.createDataFrame(docs, "id long, t array<string>")
    weights, norm = {}, {}
    edges = graph.token_edges(df, "id", "t", w)
    for e in edges.collect():
        weights.setdefault(e.id, {})[e.src, e.dst] = e.windows
        norm[e.id, e.src, e.dst] = e.norm
    for i, t in docs:
        assert weights.get(i, {}) == sliding(t or [], w)
    # the steps for edge tables agree with those inside the row
    plain = edges.select("id", "src", "dst", "w")
    assert {(r.id, r.src, r.dst): r.w for r in graph.normalized(plain).collect()} == pytest.approx(norm)
    nodes = {(r.id, r.node): r.degree for r in graph.token_nodes(df, "id", "t", w).collect()}
    assert nodes == {(r.id, r.src): r.degree for r in graph.degrees(plain).collect()}
    valued = df.withColumn("x", F.transform("t", lambda x: x.cast("double") - 2))
    features = plain.select("id", F.col("src").alias("node")).distinct().withColumn("x", F.col("node").cast("double") - 2)
    want = {(r.id, r.node): r.x for r in graph.hop(graph.normalized(plain), features).collect()}
    assert {(r.id, r.node): r.x for r in graph.token_hop(valued, "id", "t", "x", w).collect()} == pytest.approx(want)


def dense(ids, window):
    """Distinct ids and the normalised matrix of those that share a window, from the definition."""
    nodes = sorted(set(ids))
    a = np.zeros((len(nodes), len(nodes)))
    for p in range(len(ids)):
        for q in range(max(0, p - window + 1), p):
            if ids[p] != ids[q]:
                i, j = nodes.index(ids[p]), nodes.index(ids[q])
                a[i, j] = a[j, i] = 1
    d = a.sum(axis=1)
    scale = np.array([1 / np.sqrt(x) if x else 0 for x in d])
    return nodes, a * scale[:, None] * scale[None, :]


def network(ids, w, window):
    """One document's probability and embedding with dense matrices."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    nodes, norm = dense(ids, window)
    x = np.maximum(norm @ w["table"][nodes] @ w["layer0"], 0)
    x = x + np.maximum(norm @ x @ w["layer1"], 0)
    y = sigmoid(x @ w["attention"]) * np.maximum(x @ w["value"], 0)
    g = y.sum(axis=0) * y.max(axis=0)
    v = np.maximum(g @ w["embed0"], 0) @ w["embed1"]
    return sigmoid(np.tanh(g @ w["dense"]) @ w["out"])[0], v / (np.linalg.norm(v) or 1)


def test_graph_scores_equal_dense_matrices(spark):
    r = np.random.default_rng(8)
    shapes = {"table": (40, 5), "layer0": (5, 5), "layer1": (5, 5), "attention": (5, 1), "value": (5, 5), "dense": (5, 4), "out": (4, 1), "embed0": (5, 6), "embed1": (6, 3)}
    w = {k: r.normal(0, 0.7, s) for k, s in shapes.items()}
    docs = [(i, [int(x) for x in r.integers(0, 40, n)]) for i, n in enumerate([1, 2, 3, 8, 30, 200, 0, 5])] + [(8, None), (9, [3] * 50)]
    df = spark.createDataFrame(docs, "id long, ids array<int>").repartition(2)
    got = {x.id: x for x in model.graph_scores(df, "id", "ids", w).collect()}
    assert len(got) == len(docs)
    for i, ids in docs:
        p, v = network(ids, w, 3) if ids else (0.5, np.zeros(3))
        assert math.isclose(got[i].cls_prob, p, abs_tol=1e-12) and np.allclose(got[i].embedding, v)
    assert model.graph_scores(df.limit(0), "id", "ids", w).count() == 0
    entries = spark.createDataFrame([("a", "x  y\nz", "p"), ("b", "", "x y z"), ("c", None, "")], "exploit_id string, harness_template string, payload_template string")
    ids_of = lambda c: F.transform(text.tokens(c), lambda t: F.pmod(F.crc32(t), F.lit(40)).cast("int"))
    vectors_of = {x.exploit_id: x.embedding for x in model.encode_catalogue(entries, ids_of, w).collect()}
    assert vectors_of.keys() == {"a", "b"} and np.allclose(vectors_of["a"], vectors_of["b"])


def test_large_vocabulary_scores_in_the_scanner(spark):
    r = np.random.default_rng(2)
    shapes = {"table": (50_000, 128), "layer0": (128, 8), "attention": (8, 1), "value": (8, 8), "dense": (8, 4), "out": (4, 1), "embed0": (8, 6), "embed1": (6, 4)}
    w = {k: r.normal(0, 0.2, s) for k, s in shapes.items()}
    ids_of = lambda c: F.transform(text.tokens(c), lambda t: F.pmod(F.crc32(t), F.lit(50_000)).cast("int"))
    codes = spark.createDataFrame([(i, f"int f{i}(int a) {{ return a + {i}; }}") for i in range(6)], "sample_id long, code string").repartition(3)
    scored = model.score_function(w, ids_of)(codes)
    want = {x.id: x.cls_prob for x in model.graph_scores(codes.select("sample_id", ids_of(F.col("code")).alias("ids")), "sample_id", "ids", w).collect()}
    assert scored.columns == ["sample_id", "code", "cls_prob", "embedding"] and len(set(want.values())) == 6
    index = spark.createDataFrame([(9, [1.0, 0.0, 0.0, 0.5], 1, "exec")], "vec_id long, embedding array<double>, label int, vuln_type string")
    got = api.Scanner(index, api.ScanConfig(taint=False), score_fn=model.score_function(w, ids_of)).scan_batch(codes).collect()
    assert {x.sample_id: x.cls_prob for x in got} == want and {x.vuln_type for x in got} == {"exec"}
    with pytest.raises(ValueError, match="bytes of weights"):
        model.shipped(spark, {"table": np.lib.stride_tricks.as_strided(np.zeros(1), (1 << 28,), (0,))})


def test_layers(spark):
    ids = np.array([5, 7, 5, 9, 7])
    nodes, norm = dense(ids.tolist(), 2)
    g = graph.Graphs(np.unique(ids, return_inverse=True)[1], np.array([5]), 2)
    x = np.random.default_rng(1).normal(size=(3, 3))
    assert np.allclose(model.messages(g, x), norm @ x) and np.allclose(model.gcn(g, x, x), np.maximum(norm @ x @ x, 0))
    assert np.allclose(model.lora(x, x, np.ones((3, 1)), np.ones((1, 3)), 2.0), x @ x + x.sum(axis=1, keepdims=True) * 2)
    w = {k: np.full((3, 3), 0.1) for k in ("z_in", "z_self", "r_in", "r_self", "h_in", "h_self")}
    z = 1 / (1 + np.exp(-(norm @ x @ w["z_in"] + x @ w["z_self"])))
    r = 1 / (1 + np.exp(-(norm @ x @ w["r_in"] + x @ w["r_self"])))
    new = np.maximum(norm @ x @ w["h_in"] + (r * x) @ w["h_self"], 0)
    assert np.allclose(model.gated_step(g, x, w), new * z + x * (1 - z))
    both = model.read_out(np.vstack((x, x)), np.array([0, 3]), np.ones((3, 1)), np.eye(3), "concat")
    assert both.shape == (2, 6) and np.allclose(both[0], both[1])


def polynomials(norm, order, largest=None):
    n = len(norm)
    scaled = 2 / (largest or np.linalg.eigvalsh(np.eye(n) - norm).max()) * (np.eye(n) - norm) - np.eye(n)
    out = [np.eye(n), scaled]
    while len(out) <= order:
        out.append(2 * scaled @ out[-1] - out[-2])
    return out[: order + 1]


def test_chebyshev_terms_of_edges(spark):
    r, edges, want = np.random.default_rng(4), [], {}
    for i, n in enumerate([2, 3, 8]):
        _, norm = dense([int(x) for x in r.permutation(n)] * 2, 2)
        want[i] = polynomials(norm, 3)
        edges += [(i, a, b, float(norm[a, b])) for a in range(n) for b in range(n) if norm[a, b]]
    df = spark.createDataFrame(edges, "id long, src int, dst int, w double")
    terms = model.chebyshev_terms(df, 3).collect()
    got = {i: [np.zeros_like(t) for t in want[i]] for i in want}
    for x in terms:
        got[x.id][x.k][x.i, x.j] = x.value
    assert len({(x.id, x.k, x.i, x.j) for x in terms}) == len(terms)
    assert all(np.allclose(got[i][k], want[i][k], atol=1e-9) for i in want for k in range(4))
    assert model.chebyshev_terms(df.limit(0), 2).count() == 0


def test_chebyshev_of_token_graphs(spark):
    r = np.random.default_rng(9)
    docs = [(i, [f"t{x}" for x in r.integers(0, 60, n)]) for i, n in enumerate([1, 2, 5, 40, 400, 3])] + [(6, []), (7, None), (8, ["a", "b"] * 4), (9, ["z"] * 5)]
    df = spark.createDataFrame([(i, t, None if t is None else [float(len(x) + ord(x[-1])) for x in t]) for i, t in docs], "id long, t array<string>, x array<double>").repartition(2)
    largest = {x.id: x for x in model.largest_eigenvalues(df, "id", "t").collect()}
    assert len(largest) == 10 and largest[6].largest == largest[7].largest == 0 and math.isclose(largest[8].largest, 2)
    for bound in (None, 2.0):
        rows = model.token_chebyshev(df, "id", "t", "x", 3, largest=bound).collect()
        for i, tokens in docs:
            mine = {x.node: x.terms for x in rows if x.id == i}
            assert mine.keys() == set(tokens or [])
            if tokens:
                nodes, norm = dense(tokens, 3)
                assert math.isclose(largest[i].largest, np.linalg.eigvalsh(np.eye(len(nodes)) - norm).max(), abs_tol=1e-9) and largest[i].nodes == len(nodes)
                value = np.array([float(len(x) + ord(x[-1])) for x in nodes])
                for k, t in enumerate(polynomials(norm, 3, bound)):
                    assert np.allclose([mine[x][k] for x in nodes], t @ value)
    assert model.token_chebyshev(df.limit(0), "id", "t", "x", 2).count() == 0


def test_chebyshev_terms_lose_no_digit_to_cancelling(spark):
    r = np.random.default_rng(3)
    pairs = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.normal(size=(50, 2)))]
    df = spark.createDataFrame([(i, ["a", "b"], [x, y]) for i, x, y in pairs], "id long, t array<string>, x array<double>")
    got = {(r.id, r.node): r.terms for r in model.token_chebyshev(df, "id", "t", "x", 3, largest=2.0).collect()}
    for i, x, y in pairs:
        assert got[i, "a"] == [x, -y, x, -y] and got[i, "b"] == [y, -x, y, -x]


def test_conv_read_out():
    r = np.random.default_rng(6)
    h, f = r.normal(size=(14, 2)), r.normal(size=(14, 3))
    w = {"conv0": r.normal(size=(3, 2, 2)), "conv1": r.normal(size=(1, 2, 2)), "score": r.normal(size=(2, 1)),
         "both_conv0": r.normal(size=(3, 5, 5)), "both_conv1": r.normal(size=(1, 5, 5)), "both_score": r.normal(size=(5, 1))}

    def branch(x, wide, narrow, score):
        first = [[max(0, sum(x[i + k][a] * wide[k][a][b] for k in range(3) for a in range(len(x[0])))) for b in range(len(x[0]))] for i in range(len(x) - 2)]
        first = [[max(first[i + k][b] for k in range(3)) for b in range(len(x[0]))] for i in range(0, len(first) - 2, 2)]
        second = [[max(0, sum(y[a] * narrow[0][a][b] for a in range(len(y)))) for b in range(len(y))] for y in first]
        second = [[max(second[i][b], second[i + 1][b]) for b in range(len(x[0]))] for i in range(0, len(second) - 1, 2)]
        return [sum(y[a] * score[a][0] for a in range(len(y))) for y in second]

    one, two = branch(h.tolist(), w["conv0"], w["conv1"], w["score"]), branch(np.hstack((h, f)).tolist(), w["both_conv0"], w["both_conv1"], w["both_score"])
    mean = sum(a * b for a, b in zip(one, two, strict=True)) / len(one)
    several = np.repeat([0, 1, 3, 4], [6, 14, 1, 14])  # graph 2 has no node
    got = model.conv_read_out(np.vstack((h[:6], h, h[:1], h)), np.vstack((f[:6], f, f[:1], f)), several, w, 5)
    assert got[[0, 2, 3]].tolist() == [0.5] * 3 and np.allclose(got[[1, 4]], 1 / (1 + math.exp(-mean)))
    assert model.conv_read_out(h[:0], f[:0], several[:0], w, 1).tolist() == [0.5]


def test_position_edges(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b", "c"]), (2, ["x"]), (3, []), (4, None)], "id long, t array<string>")
    got = {(r.id, r.src, r.dst) for r in graph.position_edges(df, "id", "t", 3).collect()}
    assert got == {(1, p, q) for p in range(4) for q in range(4) if 0 < abs(p - q) < 3}


def test_baseline_learns(spark, tmp_path):
    rows = [(i, f"int f{i}(char *s) {{ {'strcpy(b, s);' if i % 2 else 'return 0;'} }}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, func string, target int")
    fitted = model.train_baseline(df)
    model.save(fitted, str(tmp_path / "m"))
    got = model.score_baseline(model.load(str(tmp_path / "m")), df).collect()
    assert model.train_best(df, df, penalties=(10.0, 0.01))[1] == 1.0
    assert all((r.cls_prob > 0.5) == bool(r.target) for r in got)


# ---- text ---------------------------------------------------------------------------------------------------


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    ("code", "name"),
    [("void load_rows(char *s) { }", "load_rows"), ("long add_all(int a, int b)", "add_all"), ("static int tail_of(void)", "tail_of"), ("x = 1;", "vulnerable_function"), ("int main() { }", "vulnerable_function"), ("bare(a) { }", "bare")],
)
def test_function_name(spark, code, name):
    assert one(spark, code, text.function_name) == name


def test_text_functions(spark):
    assert one(spark, "  a\t\n b 　c ", text.squeeze) == "a b c"
    assert one(spark, "if (x) y++;", text.tokens) == ["if", "(", "x", ")", "y", "+", "+", ";"]
    assert one(spark, "a b", lambda c: text.framed(text.tokens(c), 5)) == ["<s>", "a", "b", "</s>", "<pad>"]
    assert one(spark, "a b c d", lambda c: text.framed(text.tokens(c), 4)) == ["<s>", "a", "b", "</s>"]
    assert one(spark, 'a = "/* x */"; // y\n\nb = \'"\'; /* z\n*/ c', text.strip_comments) == 'a = "/* x */";  \nb = \'"\';   c'
    assert one(spark, "f(g(1)); h (2)", text.call_names) == ["f", "g", "h"]
    assert one(spark, "a\nb", text.numbered) == "     1  a\n     2  b"
    assert one(spark, "I'll say (no)!", text.clean_words) == r"i 'll say \( no \) !"
    assert one(spark, 'def f():\n    """doc"""\n    x = "# no"  # yes\n\n    return x\n', text.strip_python_comments) == 'def f():\n    x = "# no"  \n    return x'
    assert one(spark, "int  main (void)", text.defines_main)
    asked = one(spark, "int x;", lambda c: text.triage_prompt(c, F.lit("t"), F.lit(""), F.lit(0.5), F.lit("")))
    assert asked.startswith("### Detection\nType: t\nWeakness: N/A\nScore: 0.5000\n\n### Taint context\nNone") and "     1  int x;" in asked
    assert one(spark, "int x;", lambda c: text.review_prompt(c, F.lit("argv to gets"))).startswith("### Taint context\nargv to gets\n\n### Code")


# ---- source to sink -----------------------------------------------------------------------------------------


def samples(spark, *codes):
    return spark.createDataFrame(list(enumerate(codes)), "sample_id long, code string")


def test_paths_and_categories(spark):
    df = samples(spark, "int go(char **argv) {\n  popen(argv[2], m);\n}", "int main() { puts(\"x\"); }", "void put(char *argv) { sprintf(b, argv); }")
    got = [(r.sample_id, r.source_func, r.sink_func, r.sink_category) for r in taint.paths(df).collect()]
    assert sorted(got) == [(0, "argv", "popen", "exec"), (2, "argv", "sprintf", "memory")]


def test_dangerous_functions_and_types(spark):
    df = samples(spark, "void f(char *argv) {\n gets(argv);\n strcpy(a, argv);\n gets(argv);\n}")
    assert taint.dangerous_functions(taint.paths(df)).first().functions == ["gets", "strcpy"]
    index = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "vec_id long, vuln_type string")
    assert [r.vuln_type for r in vector_search.types(index).collect()] == ["a"] and vector_search.of_type(index, "a").count() == 2


def test_path_cap_keeps_the_first(spark):
    code = "\n".join(["argv argc stdin"] + [f"strcpy(a{i}, b);" for i in range(30)])
    got = taint.paths(samples(spark, code)).orderBy("path_no").collect()
    assert [(r.source_func, r.sink_line) for r in got] == [("argv", i + 2) for i in range(20)]


def test_functions_calls_callers(spark):
    df = samples(spark, "void keep(char *s) {\n  strcat(b, s);\n}\nint start(int n, char **argv) {\n  keep(argv[n]);\n}\nint one(int x) { return x; }\nif (a) { b(); }")
    f = taint.functions_of(df)
    assert sorted((r.name, r.start_line, r.end_line) for r in f.collect()) == [("keep", 1, 3), ("one", 7, 8), ("start", 4, 6)]
    edges = taint.call_edges(df, f)
    pairs = {(r.caller, r.callee) for r in edges.collect()}
    assert {("keep", "strcat"), ("start", "keep")} <= pairs
    wanted = spark.createDataFrame([(0, "strcat")], "sample_id long, func string")
    assert {r.caller for r in taint.callers(edges, wanted).collect()} == {"keep", "start"}


def test_callers_survive_cycles(spark):
    edges = spark.createDataFrame([(0, "a", "b", 1), (0, "b", "a", 2), (0, "c", "a", 3)], "sample_id long, caller string, callee string, line int")
    wanted = spark.createDataFrame([(0, "a")], "sample_id long, func string")
    assert {r.caller for r in taint.callers(edges, wanted).collect()} == {"b", "c"}


def test_closing_lines_against_plain_search():
    r = np.random.default_rng(4)
    for _ in range(60):
        depth = np.concatenate(([0], np.cumsum(r.integers(-2, 3, r.integers(1, 40)))))
        starts = [int(s) for s in r.integers(1, len(depth), 6)]
        want = [next((i for i in range(s + 1, len(depth)) if depth[i] <= depth[s - 1]), s) for s in starts]
        assert taint.closing_lines(depth, starts) == want


def test_spans_and_calls_of_a_long_file(spark):
    n = 20_000  # functions of five lines
    code = "".join(f"int f{i}(int a) {{\n  if (a) {{\n    f{i + 1}(a);\n  }}\n}}\n" for i in range(n))
    df = samples(spark, code).cache()
    begin = time.perf_counter()
    f = taint.functions_of(df)
    spans = {(r.name, r.start_line, r.end_line) for r in f.collect()}
    assert spans == {(f"f{i}", 5 * i + 1, 5 * i + 5) for i in range(n)}
    assert taint.call_edges(df, f).count() == n
    assert time.perf_counter() - begin < 60  # 100,000 lines; quadratic work would take hours


def test_calls_meet_functions_across_bins(spark):
    r = np.random.default_rng(9)
    lines = [["int f%d(int a) {", "g%d(1);", "}", "{ h%d(2);", "x = 1;"][j] for j in r.integers(0, 5, 400)]
    code = "\n".join(x % i if "%d" in x else x for i, x in enumerate(lines))
    df = samples(spark, code)
    f = taint.functions_of(df)
    spans = [(x.name, x.start_line, x.end_line) for x in f.collect()]
    want = set()
    for no, text in enumerate(code.split("\n"), 1):
        for callee in re.findall(r"\b(\w+)\s*\(", text):
            want |= {(name, callee, no) for name, a, b in spans if a <= no <= b and name != callee and callee not in rules.CONTROL_WORDS}
    assert {(x.caller, x.callee, x.line) for x in taint.call_edges(df, f).collect()} == want


def test_callers_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    n, rounds = 1000, []
    cut = taint.cut
    monkeypatch.setattr(taint, "cut", lambda df, label: rounds.append(label) or cut(df, label))
    edges = spark.createDataFrame([(0, f"f{i}", f"f{i + 1}", i) for i in range(n)], "sample_id long, caller string, callee string, line int")
    wanted = spark.createDataFrame([(0, f"f{n}")], "sample_id long, func string")
    assert taint.callers(edges, wanted).count() == n
    assert rounds.count("callers") - 1 <= 12


def test_callers_against_plain_closure(spark):
    r = np.random.default_rng(12)
    pairs = {(int(s), f"n{a}", f"n{b}") for s, a, b in zip(r.integers(0, 3, 60), r.integers(0, 14, 60), r.integers(0, 14, 60), strict=True)}
    want = set()
    for s, _, func in pairs:
        seen, fresh = set(), {func}
        while fresh:
            seen |= fresh
            fresh = {a for t, a, b in pairs if t == s and b in fresh} - seen
        want |= {(s, func, c) for c in seen - {func}}
    edges = spark.createDataFrame([(*p, 1) for p in pairs], "sample_id long, caller string, callee string, line int")
    got = taint.callers(edges, edges.select("sample_id", F.col("callee").alias("func")).distinct())
    assert {tuple(x) for x in got.select("sample_id", "func", "caller").collect()} == want


# ---- reviews ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("response", "want"),
    [
        ('{"verdict": "true_positive", "confidence": 0.9, "reasoning": "r"}', ("true_positive", 0.9, "r")),
        ('```json\n{"verdict": "false_positive", "confidence": 3}\n```', ("false_positive", 1.0, "No reasoning provided")),
        ('Well: {"verdict": "uncertain", "confidence": -1, "reasoning": "x"} and {more}', ("uncertain", 0.0, "x")),
        ('{"verdict": "sure", "confidence": "0.25"}', ("uncertain", 0.25, "No reasoning provided")),
        ('see {"a": {"b": 1}} ok', ("uncertain", 0.5, "No reasoning provided")),
        ("nothing", ("uncertain", 0.0, "Failed to parse LLM response: nothing")), (None, ("uncertain", 0.0, "Failed to parse LLM response: ")),
    ],
)
def test_triage(spark, response, want):
    r = triage.parse_triage(spark.createDataFrame([(response,)], "response string")).first()
    assert (r.verdict, r.confidence, r.reasoning) == want


def test_adapter_responses(spark):
    assert json.loads(one(spark, 'x ```json\n{"a": 1}\n``` y', triage.adapter_json)) == {"a": 1}
    assert json.loads(one(spark, 'x {"a": {"b": 2}} y', triage.adapter_json)) == {"a": {"b": 2}}
    assert one(spark, "none", triage.adapter_json) is None
    assert one(spark, "```c\nint main() { }\n```", triage.code_block) == "int main() { }"
    assert one(spark, "```c\nint f() { }\n```", triage.code_block) is None


# ---- selection ----------------------------------------------------------------------------------------------


def test_selection(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(10)], "idx long, func string")
    assert sorted(r.idx for r in selection.dedup_by_content(df, "func", "idx").collect()) == [0, 1, 2]
    tied = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "a", "z"), (2, "a", "w"), (3, None, "v"), (3, None, "u"), (None, "c", "t")], "idx long, func string, __k string")
    kept = sorted((str(r.idx), str(r.func)) for r in selection.dedup_by_content(tied, "func", "idx").collect())
    assert kept == [("1", "a"), ("1", "b"), ("3", "None"), ("None", "c")]
    assert selection.sample(df, 0.35).count() == 3
    a, b = ({r.idx for r in selection.sample(df.repartition(n), 0.35).collect()} for n in (1, 3))
    assert a == b
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "idx long")
    got = sorted((r.idx, r.split) for r in selection.assign_split(df, {"train": ids(1, 1, 2), "test": ids(2, 99)}).collect())
    assert got == [(1, "train"), (2, "test"), (2, "train")]
    assert selection.replay_mix(df.filter("idx < 4"), df.filter("idx >= 4"), 0.5).groupBy("is_new").count().orderBy("is_new").collect() == [(0, 3), (1, 4)]
    assert {r.idx for r in selection.mask(df, ids(3, 4)).filter("selected").collect()} == {3, 4}
    keyed = selection.dedup_by_key(df, ["func"], [F.col("idx").desc()], head=2)
    assert sorted(r.idx for r in keyed.collect()) == [8, 9]


# ---- reports and the scanner --------------------------------------------------------------------------------


def scanned(spark):
    r = np.random.default_rng(0)
    vec = lambda: [float(x) for x in r.standard_normal(8)]
    index = spark.createDataFrame([(100 + i, vec(), i % 2, "buffer_overflow" if i % 2 else None) for i in range(20)], "vec_id long, embedding array<double>, label int, vuln_type string")
    code = "int main(int argc, char **argv) {\n  strcpy(b, argv[1]);\n}"
    rows = [(i, code, p, vec()) for i, p in ((1, 0.95), (2, 0.05), (3, 0.9))]
    df = spark.createDataFrame(rows, "sample_id long, code string, cls_prob double, embedding array<double>")
    logs = spark.createDataFrame(
        [(1, 1, 0, 1, "", "AddressSanitizer: heap-buffer-overflow", False, [], True, 0.5, "asan_ubsan", False), (2, 1, 1, 0, "", "", False, [], True, 0.25, "asan_ubsan", False)],
        schemas.SCHEMAS["exec_log"],
    )
    reviews = spark.createDataFrame([(3, '{"verdict": "false_positive", "confidence": 0.9, "reasoning": "bounded"}')], "sample_id long, response string")
    return index, df, logs, reviews


def test_scanner(spark):
    index, df, logs, reviews = scanned(spark)
    config = api.ScanConfig(beta=0.9)
    results = api.Scanner(index, config).scan_batch(df, logs, reviews)
    assert results.columns == schemas.SCHEMAS["scan_results"].names
    got = {r.sample_id: r for r in results.collect()}
    assert got[1].verdict == "CONFIRMED" and got[1].cwe_id == "CWE-122" and got[1].exploits_tried == 1 and len(got[1].evidence_details) == 1
    assert got[2].verdict == "SAFE" and got[2].evidence_details == [] and "strcpy" in got[1].taint_context
    assert got[3].verdict == "SAFE" and got[3].triage_verdict == "false_positive"
    dry = {r.sample_id: r.verdict for r in api.Scanner(None, api.ScanConfig(mode="dry-run", taint=False)).scan_batch(df, logs, reviews).collect()}
    assert dry == {1: "SUGGESTIVE", 2: "SAFE", 3: "SUGGESTIVE"}
    with pytest.raises(ValueError, match="mode"):
        api.ScanConfig(mode="other")


def test_scanner_counts_the_first_runs_only(spark):
    _, df, _, _ = scanned(spark)
    fields = schemas.SCHEMAS["exec_log"].names
    log = lambda ord_, text: tuple({"sample_id": 1, "ord": ord_, "exit_code": 1 if text else 0, "stdout": "", "stderr": text, "execution_time": 1.0, "timed_out": False, "compiled": True}.get(f) for f in fields)
    crash = "==1==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x1"
    logs = spark.createDataFrame([log(i, crash if i == 3 else "") for i in range(5)], schemas.SCHEMAS["exec_log"])
    tried = {}
    for most in (2, 4):
        r = api.Scanner(None, api.ScanConfig(max_exploits=most, taint=False)).scan_batch(df, logs).filter("sample_id = 1").first()
        tried[most] = (r.exploits_tried, r.exploits_confirmed, len(r.evidence_details))
    assert tried == {2: (2, 0, 2), 4: (4, 1, 4)}


def test_scanner_scores_by_function(spark):
    _, df, _, _ = scanned(spark)
    bare = df.select("sample_id", "code")
    calls = []

    def score(samples):
        calls.append(1)
        return samples.withColumn("cls_prob", F.when(F.col("sample_id") == 2, 0.1).otherwise(0.9))

    got = {r.sample_id: (r.cls_prob, r.verdict) for r in api.Scanner(config=api.ScanConfig(taint=False), score_fn=score).scan_batch(bare).collect()}
    assert got == {1: (0.9, "SUGGESTIVE"), 2: (0.1, "SAFE"), 3: (0.9, "SUGGESTIVE")} and len(calls) == 1
    assert {r.cls_prob for r in api.Scanner(config=api.ScanConfig(taint=False)).scan_batch(bare).collect()} == {1.0}


def test_reports(spark):
    index, df, logs, reviews = scanned(spark)
    results = api.Scanner(index, api.ScanConfig(beta=0.9)).scan_batch(df, logs, reviews).cache()
    texts = {r.sample_id: r.report for r in report.result_report(results, verbose=True).collect()}
    assert "[!!] CONFIRMED" in texts[1] and "--- Exploit #1" in texts[1] and "Triage Head" in texts[3] and "Triage Head" not in texts[1]
    data = {r.sample_id: json.loads(r.json) for r in report.result_json(results).collect()}
    assert data[1]["cwe_id"] == "CWE-122" and "triage_verdict" not in data[1] and data[3]["triage_confidence"] == 0.9
    summary = report.batch_summary(results).first().summary
    assert summary.startswith("Batch Summary (3 samples):") and "CONFIRMED:  1 (33.3%)" in summary
    assert report.batch_summary(results.limit(0)).first().summary == "No results."
