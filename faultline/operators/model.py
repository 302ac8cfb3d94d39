"""Models: a trained baseline over hashed tokens, and graph networks applied with given weights (``network`` trains them).

The baseline's training is MLlib's. The graphs of many documents
are one sparse graph in an Arrow batch, so layers run over their edges in numpy, with no exchange and no dense matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squeeze
from ..plans.lineage import cut
from .graph import WINDOW, Graphs, batched

FEATURES, EPOCHS, REGULAR = 1 << 14, 25, 0.01


def train_baseline(samples: DataFrame, text: str = "func", label: str = "target", features: int = FEATURES, penalty: float = REGULAR) -> PipelineModel:
    """Logistic regression over hashed words; fitted where the rows are."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\W+", toLowercase=False),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features, binary=True),
        LogisticRegression(featuresCol="__tf", labelCol=label, maxIter=EPOCHS, regParam=penalty, predictionCol="__prediction", probabilityCol="__prob", rawPredictionCol="__raw"),
    ]
    return Pipeline(stages=stages).fit(samples.filter(F.col(text).isNotNull() & F.col(label).isNotNull()))


def train_best(samples: DataFrame, valid: DataFrame, text: str = "func", label: str = "target", penalties: tuple[float, ...] = (0.1, REGULAR, 0.001)) -> tuple[PipelineModel, float]:
    """The model of highest accuracy on ``valid`` among several penalties, the first of equals, and that accuracy."""
    best, best_accuracy = None, -1.0
    for penalty in penalties:
        model = train_baseline(samples, text, label, penalty=penalty)
        hit = F.avg(((F.col("cls_prob") > 0.5).cast("int") == F.col(label)).cast("int"))
        accuracy = score_baseline(model, valid, text).agg(hit).first()[0] or 0.0
        if accuracy > best_accuracy:
            best, best_accuracy = model, accuracy
    return best, best_accuracy


def score_baseline(model: PipelineModel, samples: DataFrame, text: str = "func") -> DataFrame:
    """Adds cls_prob; a null text scores as an empty one."""
    scored = model.transform(samples.withColumn(text, F.coalesce(text, F.lit(""))))
    return scored.withColumn("cls_prob", vector_to_array("__prob")[1]).select(*samples.columns, "cls_prob")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---- layers, on numpy arrays --------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def messages(g: Graphs, x: np.ndarray) -> np.ndarray:
    """The normalised sum of the neighbours' rows for every node of several graphs, a column at a time."""
    return np.stack([np.bincount(g.src, weights=g.norm * c[g.dst], minlength=len(g.code)) for c in x.T], axis=1)


def gcn(g: Graphs, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.maximum(messages(g, x @ weight), 0)


def gated_step(g: Graphs, x: np.ndarray, w: Mapping[str, np.ndarray]) -> np.ndarray:
    """One gated step: messages update node states through update and reset gates."""
    m = messages(g, x)
    z = sigmoid(m @ w["z_in"] + x @ w["z_self"])
    r = sigmoid(m @ w["r_in"] + x @ w["r_self"])
    new = np.maximum(m @ w["h_in"] + (r * x) @ w["h_self"], 0)
    return new * z + x * (1 - z)


def lora(x: np.ndarray, weight: np.ndarray, down: np.ndarray, up: np.ndarray, scale: float) -> np.ndarray:
    """A frozen linear map with a low-rank correction."""
    return x @ weight + (x @ down) @ up * scale


def read_out(x: np.ndarray, starts: np.ndarray, attention: np.ndarray, value: np.ndarray, how: str = "mul") -> np.ndarray:
    """Soft attention over nodes, then per graph their sum and maximum combined; a graph's nodes begin at its start."""
    y = sigmoid(x @ attention) * np.maximum(x @ value, 0)
    total, most = np.add.reduceat(y, starts, axis=0), np.maximum.reduceat(y, starts, axis=0)
    return {"sum": total + most, "mul": total * most, "concat": np.concatenate((total, most), axis=1)}[how]


def classify(graphs: np.ndarray, w: Mapping[str, np.ndarray]) -> np.ndarray:
    """Probabilities by a hidden layer and an output."""
    return sigmoid(np.tanh(graphs @ w["dense"]) @ w["out"]).ravel()


def embed(graphs: np.ndarray, w: Mapping[str, np.ndarray]) -> np.ndarray:
    """Unit vectors by two layers; a zero vector stays."""
    v = np.maximum(graphs @ w["embed0"], 0) @ w["embed1"]
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def convolve(x: np.ndarray, owner: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of several graphs convolved along their order, and the graphs of what is left: ``kernel`` is width x in x out,
    no padding, so that a graph of n rows keeps n - width + 1; then cut at zero."""
    k = len(kernel)
    at = np.flatnonzero(owner[: max(len(x) - k + 1, 0)] == owner[k - 1 :])
    return np.maximum(sum(x[at + i] @ kernel[i] for i in range(k)), 0), owner[at]


def pooled(x: np.ndarray, owner: np.ndarray, size: int, step: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of ``size`` rows, every ``step`` of each graph, and their graphs; what does not fill a window is left out."""
    place = np.arange(len(x)) - np.searchsorted(owner, owner)
    at = np.flatnonzero((owner[: max(len(x) - size + 1, 0)] == owner[size - 1 :]) & (place[: max(len(x) - size + 1, 0)] % step == 0))
    return np.maximum.reduce([x[at + i] for i in range(size)]), owner[at]


def conv_read_out(states: np.ndarray, features: np.ndarray, owner: np.ndarray, w: Mapping[str, np.ndarray], n: int) -> np.ndarray:
    """Probabilities of graphs 0 to n - 1: node states, and states beside features, each through two convolutions and pools;
    their scores are multiplied and averaged. ``owner`` rises. Fewer than seven nodes fill no window and give 0.5."""

    def branch(x: np.ndarray, wide: str, narrow: str, score: str) -> tuple[np.ndarray, np.ndarray]:
        x, of = pooled(*convolve(x, owner, w[wide]), 3)
        x, of = pooled(*convolve(x, of, w[narrow]), 2)
        return (x @ w[score])[:, 0], of

    alone, of = branch(states, "conv0", "conv1", "score")
    beside, _ = branch(np.concatenate((states, features), axis=1), "both_conv0", "both_conv1", "both_score")
    count = np.bincount(of, minlength=n)
    return sigmoid(np.bincount(of, weights=alone * beside, minlength=n) / np.maximum(count, 1))


#: A graph's largest eigenvalue is taken when its residual is at most so much, checked every so many Lanczos steps, of at most so many.
RESIDUAL, CHECK_EVERY, MOST_STEPS = 1e-7, 12, 600


def ritz(alphas: np.ndarray, betas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalue of each tridiagonal matrix and the residual of its vector; ``betas`` has one more after the last row."""
    steps = alphas.shape[1]
    t = np.zeros((len(alphas), steps, steps))
    t[:, np.arange(steps), np.arange(steps)] = alphas
    t[:, np.arange(steps - 1), np.arange(1, steps)] = t[:, np.arange(1, steps), np.arange(steps - 1)] = betas[:, : steps - 1]
    values, vectors = np.linalg.eigh(t)
    return values[:, -1], betas[:, steps - 1] * np.abs(vectors[:, -1, -1])


def lanczos(g: Graphs) -> tuple[np.ndarray, np.ndarray]:
    """Graphs that have nodes and the largest eigenvalues of their normalised Laplacians, all graphs a step at a time. Only two
    vectors are held: lost orthogonality repeats eigenvalues, but leaves the largest as it is."""
    which, starts, owner = np.unique(g.owner, return_index=True, return_inverse=True)
    place = np.argsort(np.argsort(g.first)) - starts[owner]
    summed = lambda x: np.bincount(owner, weights=x, minlength=len(which))
    v = 1.5 + np.sin(1.0 + place * (place + 0.618))  # by a node's place, so that a graph's figures are its own
    v /= np.sqrt(summed(v * v))[owner]
    before, beta = np.zeros_like(v), np.zeros(len(which))
    alphas, betas = [], []
    largest, left = np.zeros(len(which)), np.arange(len(which))
    while len(left):
        w = v - np.bincount(g.src, weights=g.norm * v[g.dst], minlength=len(v)) - beta[owner] * before
        alpha = summed(v * w)
        w -= alpha[owner] * v
        beta = np.sqrt(summed(w * w))
        beta[beta < 1e-10] = 0  # the graph's vectors are used up
        before, v = v, np.where(beta[owner] > 0, w / np.where(beta > 0, beta, 1)[owner], 0)
        alphas.append(alpha)
        betas.append(beta)
        if len(alphas) % CHECK_EVERY == 0 or not beta[left].any():
            found, off = ritz(np.stack([a[left] for a in alphas], axis=1), np.stack([b[left] for b in betas], axis=1))
            largest[left] = found
            left = left[off > RESIDUAL] if len(alphas) < MOST_STEPS else left[:0]
    return which, largest


def _graphs_of(words: pa.DictionaryArray, sizes: np.ndarray, window: int) -> Graphs:
    return Graphs(words.indices.to_numpy().astype(np.int64), sizes.astype(np.int64), window)


def largest_eigenvalues(docs: DataFrame, id_name: str, tokens: str, window: int = WINDOW) -> DataFrame:
    """id, nodes, largest: of every document's token graph; a document without tokens has no graph and 0."""

    def emit(words: pa.DictionaryArray, sizes: np.ndarray, part: pa.RecordBatch):
        found = np.zeros(len(sizes))
        nodes = np.zeros(len(sizes), np.int64)
        if len(words):
            g = _graphs_of(words, sizes, window)
            which, values = lanczos(g)
            found[which], nodes = values, np.bincount(g.owner, minlength=len(sizes))
        return np.arange(len(sizes)), [pa.array(nodes), pa.array(found)]

    return batched(docs, id_name, [F.col(tokens)], "nodes long, largest double", emit)


def token_chebyshev(docs: DataFrame, id_name: str, tokens: str, values: str, order: int, window: int = WINDOW, largest: float | None = None) -> DataFrame:
    """id, node, terms: T_0 x to T_order x of the scaled Laplacian of each document's token graph; ``values`` runs beside ``tokens``,
    a token's value being that of its first place. The scale is each graph's own largest eigenvalue, or ``largest`` (2 bounds
    them all). The recurrence runs over edges, so memory grows with edges and no matrix is filled."""
    kind = docs.schema[tokens].dataType.elementType.simpleString()

    def emit(words: pa.DictionaryArray, sizes: np.ndarray, part: pa.RecordBatch):
        if not len(words):
            none = pa.array([], pa.list_(pa.float64()))
            return np.zeros(0, np.int64), [words.dictionary.slice(0, 0), none]
        g = _graphs_of(words, sizes, window)
        x = part.column(2).flatten().to_numpy(zero_copy_only=False)[g.first]
        if largest is None:
            which, found = lanczos(g)
            scale = np.zeros(len(sizes))
            scale[which] = 2 / found
            scale = scale[g.owner]
        else:
            scale = np.full(len(x), 2 / largest)
        # not scale * (y - sum) - y: where the scale is 1, what y cancels would cost the last digits of the sum
        scaled = lambda y: (scale - 1) * y - scale * np.bincount(g.src, weights=g.norm * y[g.dst], minlength=len(y))
        terms = [x, scaled(x)]
        while len(terms) <= order:
            terms.append(2 * scaled(terms[-1]) - terms[-2])
        flat = np.stack(terms[: order + 1], axis=1).ravel()
        starts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (order + 1))
        return g.owner, [words.dictionary.take(pa.array(g.code)), pa.ListArray.from_arrays(starts, pa.array(flat))]

    return batched(docs, id_name, [F.col(tokens), F.col(values).cast("array<double>")], f"node {kind}, terms array<double>", emit)


def edge_eigenvalues(edges: DataFrame) -> DataFrame:
    """id, largest: the largest eigenvalue of I - W of each graph of ``edges`` (id, src, dst, w; symmetric), by Lanczos steps that
    are joins: a graph may be larger than a task. Rounds go on until every graph's residual is small; a round's vectors are
    a table, and a graph keeps its coefficients as one row."""
    spark, n = edges.sparkSession, 0
    edges = cut(edges.select("id", "src", "dst", "w"), "edges")
    nodes = edges.select("id", F.col("src").alias("node")).union(edges.select("id", F.col("dst"))).distinct()
    start = nodes.withColumn("v", F.lit(1.5) + F.sin(F.pmod(F.xxhash64("node"), F.lit(1 << 20)).cast("double")))
    norm = start.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    state = cut(start.join(norm, "id").select("id", "node", F.lit(0.0).alias("u"), (F.col("v") / F.col("norm")).alias("v")), "lanczos")
    rows = state.select("id").distinct().select("id", F.array().cast("array<double>").alias("alphas"), F.array().cast("array<double>").alias("betas"))
    rows, done = cut(rows, "lanczos"), []

    def judged(batches):
        for batch in batches:
            out = {"id": batch.column(0), "largest": [], "residual": []}
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                value, off = ritz(np.array([a]), np.array([b]))
                out["largest"].append(float(value[0]))
                out["residual"].append(float(off[0]))
            yield pa.RecordBatch.from_pydict({"id": out["id"], "largest": pa.array(out["largest"], pa.float64()), "residual": pa.array(out["residual"], pa.float64())})

    last = F.coalesce(F.element_at("betas", -1), F.lit(0.0))
    while n < MOST_STEPS:
        n += 1
        near = state.select("id", F.col("node").alias("dst"), F.col("v").alias("x"))
        passed = edges.join(near, ["id", "dst"]).groupBy("id", F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("m"))
        beta = rows.select("id", (last if n > 1 else F.lit(0.0)).alias("beta"))
        w = state.join(passed, ["id", "node"], "left").join(beta, "id")
        w = cut(w.select("id", "node", "v", (F.col("v") - F.coalesce("m", F.lit(0.0)) - F.col("beta") * F.col("u")).alias("w")), "lanczos")
        # beta squared is the rest of w beside v, summed after alpha is known
        alpha = w.groupBy("id").agg(F.sum(F.col("v") * F.col("w")).alias("alpha"))
        rest = cut(w.join(alpha, "id").select("id", "node", "v", (F.col("w") - F.col("alpha") * F.col("v")).alias("w"), "alpha"), "lanczos")
        found = rest.groupBy("id").agg(F.first("alpha").alias("alpha"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("beta"))
        rows = cut(rows.join(found, "id").select("id", F.array_append("alphas", F.col("alpha")).alias("alphas"), F.array_append("betas", F.when(F.col("beta") < 1e-10, 0.0).otherwise(F.col("beta"))).alias("betas")), "lanczos")
        known = cut(rows.mapInArrow(judged, T.StructType([edges.schema["id"], T.StructField("largest", T.DoubleType()), T.StructField("residual", T.DoubleType())])), "lanczos")
        enough = F.col("residual") <= (RESIDUAL if n < MOST_STEPS else float("inf"))
        done.append(known.filter(enough).select("id", "largest"))
        rows = rows.join(known.filter(~enough).select("id"), "id", "left_semi")
        state = rest.join(rows.select("id", last.alias("beta")), "id").select("id", "node", F.col("v").alias("u"), (F.col("w") / F.col("beta")).alias("v"))
        if known.filter(~enough).isEmpty():
            break
        state, rows = cut(state, "lanczos"), cut(rows, "lanczos")
    return reduce(DataFrame.union, done) if done else spark.createDataFrame([], T.StructType([edges.schema["id"], T.StructField("largest", T.DoubleType())]))


def chebyshev_terms(edges: DataFrame, order: int) -> DataFrame:
    """id, k, i, j, value: the entries of Chebyshev polynomials T_0..T_order of the scaled Laplacian of each graph of ``edges``
    (id, src, dst, w; weights normalised), by joins; entries that no path of k edges reaches are left out."""
    largest = cut(edge_eigenvalues(edges), "largest")
    nodes = edges.select("id", F.col("src").alias("i")).union(edges.select("id", F.col("dst"))).distinct()
    unit = nodes.select("id", "i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
    whole = unit.union(edges.select("id", "src", "dst", -F.col("w"))).groupBy("id", "i", "j").agg(F.sum("value").alias("value"))
    scaled = whole.join(largest, "id").select("id", "i", "j", (2 / F.col("largest") * F.col("value") - (F.col("i") == F.col("j")).cast("double")).alias("value"))
    scaled = cut(scaled, "scaled")
    terms = [unit, scaled]
    step = scaled.select("id", "i", F.col("j").alias("via"), F.col("value").alias("a"))
    while len(terms) <= order:
        onward = terms[-1].select("id", F.col("i").alias("via"), "j", F.col("value").alias("b"))
        product = step.join(onward, ["id", "via"]).select("id", "i", "j", (2 * F.col("a") * F.col("b")).alias("value"))
        both = product.union(terms[-2].select("id", "i", "j", -F.col("value")))
        terms.append(cut(both.groupBy("id", "i", "j").agg(F.sum("value").alias("value")), "term"))
    return reduce(DataFrame.union, [t.select("id", F.lit(k).alias("k"), "i", "j", "value") for k, t in enumerate(terms[: order + 1])])


@dataclass(frozen=True)
class Network:
    """How a network is put together. ``kind``: "gcn" takes a layer for each of layer0, layer1, ...; "gated" encodes the table's
    rows (weight encode, with encode_down and encode_up a low-rank correction scaled by ``scale``) and makes ``steps`` steps of
    shared weights. ``residual`` adds what a layer is given to what it makes (not in a first gcn layer). ``how`` combines sum
    and maximum of the nodes: mul, sum or concat. ``conv``: probabilities come from convolutions over the nodes instead."""

    kind: str = "gcn"
    steps: int = 2
    residual: bool = True
    how: str = "mul"
    conv: bool = False
    scale: float = 1.0


def layers(w: Mapping[str, np.ndarray]) -> int:
    return sum(name.startswith("layer") for name in w)


def encoded(features: np.ndarray, w: Mapping[str, np.ndarray], net: Network) -> np.ndarray:
    if "encode_down" in w:
        return lora(features, w["encode"], w["encode_down"], w["encode_up"], net.scale)
    return features @ w["encode"]


def states(g: Graphs, features: np.ndarray, w: Mapping[str, np.ndarray], net: Network) -> np.ndarray:
    """Node states after all layers."""
    gated = net.kind == "gated"
    x = encoded(features, w, net) if gated else gcn(g, features, w["layer0"])
    for k in range(net.steps) if gated else range(1, layers(w)):
        new = gated_step(g, x, w) if gated else gcn(g, x, w[f"layer{k}"])
        x = x + new if net.residual else new
    return x


def forward(g: Graphs, codes: np.ndarray, w: Mapping[str, np.ndarray], net: Network = Network()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, probability, unit embedding) of every graph that has nodes; ``codes`` are the rows of ``table`` by node.

    ``w``: table, those of ``net``, attention, value, dense, out, embed0, embed1; with convolutions conv0, conv1, score,
    both_conv0, both_conv1, both_score in place of dense and out. Nodes stand in the order of their first tokens.
    """
    features = w["table"][codes]
    x = states(g, features, w, net)
    which, starts = np.unique(g.owner, return_index=True)
    graphs = read_out(x, starts, w["attention"], w["value"], net.how)
    if not net.conv:
        return which, classify(graphs, w), embed(graphs, w)
    order = np.argsort(g.first)
    prob = conv_read_out(x[order], features[order], np.searchsorted(which, g.owner[order]), w, len(which))
    return which, prob, embed(graphs, w)


#: Weights of a network may take up so many bytes: they go to every executor once.
MOST_WEIGHT_BYTES = 1 << 30


def shipped(spark: SparkSession, w: Mapping[str, np.ndarray]):
    """Weights as a broadcast: sent once to an executor and read once by a Python worker, not with every task."""
    size = sum(x.nbytes for x in w.values())
    if size > MOST_WEIGHT_BYTES:
        raise ValueError(f"{size} bytes of weights; at most {MOST_WEIGHT_BYTES} are sent to executors")
    return spark.sparkContext.broadcast(dict(w))


def graph_scores(docs: DataFrame, id_name: str, ids: str, w: Mapping[str, np.ndarray], window: int = WINDOW, net: Network = Network()) -> DataFrame:
    """id, cls_prob, embedding: one row a document of token ids; without any, probability 0.5 and a zero vector."""
    width, sent = w["embed1"].shape[1], shipped(docs.sparkSession, w)

    def emit(words: pa.DictionaryArray, sizes: np.ndarray, part: pa.RecordBatch):
        prob, vectors = np.full(len(sizes), 0.5), np.zeros((len(sizes), width))
        if len(words):
            g = Graphs(words.indices.to_numpy().astype(np.int64), sizes.astype(np.int64), window)
            which, p, v = forward(g, words.dictionary.to_numpy()[g.code], sent.value, net)
            prob[which], vectors[which] = p, v
        flat = pa.array(vectors.ravel())
        return np.arange(len(sizes)), [pa.array(prob), pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * width), flat)]

    return batched(docs, id_name, [F.col(ids).cast("array<int>")], "cls_prob double, embedding array<double>", emit)


def score_function(w: Mapping[str, np.ndarray], ids_of: Callable[[Column], Column], window: int = WINDOW, net: Network = Network()) -> Callable[[DataFrame], DataFrame]:
    """A scanner's ``score_fn``: samples (sample_id, code, ...) with the network's cls_prob and embedding; ``ids_of`` makes token
    ids of squeezed code. Of rows that share a sample_id each gets its own."""

    def score(samples: DataFrame) -> DataFrame:
        row = F.struct(*samples.columns).alias("row")
        rows = samples.select(row, ids_of(squeeze(F.col("code"))).alias("ids"))
        return graph_scores(rows, "row", "ids", w, window, net).select("id.*", "cls_prob", "embedding")

    return score


def encode_catalogue(catalogue: DataFrame, ids_of, w: Mapping[str, np.ndarray], window: int = WINDOW) -> DataFrame:
    """exploit_id, embedding of catalogue entries: their harness, else their payload, squeezed and made token ids by
    ``ids_of`` (Column -> Column). Entries without either have no vector."""
    code = F.coalesce(*[F.when(F.length(c) > 0, F.col(c)) for c in ("harness_template", "payload_template")])
    rows = catalogue.select("exploit_id", squeeze(code).alias("code")).filter(F.length("code") > 0)
    scored = graph_scores(rows.select("exploit_id", ids_of(F.col("code")).alias("ids")), "exploit_id", "ids", w, window)
    return scored.select(F.col("id").alias("exploit_id"), "embedding")
