"""Training of graph networks where the rows are.

Samples are dealt once into batches, which are written by step, so that an epoch reads every batch once and a step only its
own folder. A step's tasks run forward and backward over their batches and each give one sum of gradients, cut into blocks;
blocks are added in two rounds, so that no task adds more than some of them. The driver holds the weights, which it has to
anyway, and makes the AdamW step. After each epoch weights and moments are published as a version that names the best
and the last epoch, from which a later call goes on. Sums run in the order of tasks, so reruns agree to the bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import place
from ..sources import versions
from .graph import TOKENS_AT_ONCE, WINDOW, Graphs
from .model import Network, encoded, graph_scores, layers, messages, shipped, sigmoid

#: Numbers of one gradient block, and how many first-round sums a block has.
BLOCK, FIRST_SUMS = 1 << 16, 64
GATES = ("z_in", "z_self", "r_in", "r_self", "h_in", "h_self")


@dataclass(frozen=True)
class Training:
    """``rate`` rises linearly over the first ``warmup`` of all steps and falls linearly to 0. ``contrast`` is the share of
    the contrastive loss (``loss``: supcon or triplet) beside that of the classification; ``batch`` rows see each other in it."""

    epochs: int = 10
    steps: int = 4
    batch: int = 64
    rate: float = 5e-3
    warmup: float = 0.1
    decay: float = 0.0
    epsilon: float = 1e-8
    most_norm: float = 1.0
    contrast: float = 0.3
    loss: str = "supcon"
    temperature: float = 0.07
    margin: float = 0.3
    seed: int = 42


Weights = Mapping[str, np.ndarray]


def fresh_weights(vocabulary: int, width: int, embedding: int, net: Network = Network(), n_layers: int = 2, seed: int = 42) -> dict[str, np.ndarray]:
    """Uniform weights within the root of 6 over both widths; rows of the table are normal with deviation 1 / sqrt(width)."""
    draw = np.random.default_rng(seed)
    out_width = width * 2 if net.how == "concat" else width
    own = {"encode": (width, width), **dict.fromkeys(GATES, (width, width))} if net.kind == "gated" else {f"layer{k}": (width, width) for k in range(n_layers)}
    shapes = own | {"attention": (width, 1), "value": (width, width), "dense": (out_width, width), "out": (width, 1), "embed0": (out_width, width), "embed1": (width, embedding)}
    made = {"table": draw.normal(0, width**-0.5, (vocabulary, width))}
    return made | {name: draw.uniform(-1, 1, s) * (6 / sum(s)) ** 0.5 for name, s in shapes.items()}


# ---- losses and gradients of one batch ----------------------------------------------------------------------


def supcon(e: np.ndarray, y: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """Supervised contrastive loss of unit vectors, and its gradient: each anchor with a positive, itself left out."""
    n = len(e)
    sim = e @ e.T / temperature
    np.fill_diagonal(sim, -np.inf)
    same = (y[:, None] == y) & ~np.eye(n, dtype=bool)
    held = same.sum(axis=1)
    valid = held > 0
    if not valid.any():
        return 0.0, np.zeros_like(e)
    most = sim.max(axis=1, keepdims=True)
    spread = np.exp(sim - most)
    total = spread.sum(axis=1, keepdims=True)
    share = same / np.maximum(held, 1)[:, None]
    log_prob = np.where(same, sim - most - np.log(total), 0)
    grad = np.where(valid[:, None], spread / total - share, 0) / valid.sum()
    return float(-(share * log_prob).sum() / valid.sum()), (grad + grad.T) @ e / temperature


def triplet(e: np.ndarray, y: np.ndarray, margin: float) -> tuple[float, np.ndarray]:
    """Batch-hard triplet loss of unit vectors, and its gradient: furthest positive against nearest negative."""
    n, at = len(e), np.arange(len(e))
    far = np.sqrt(np.maximum(((e[:, None] - e) ** 2).sum(axis=2), 0))
    same = (y[:, None] == y) & ~np.eye(n, dtype=bool)
    other = y[:, None] != y
    valid = same.any(axis=1) & other.any(axis=1)
    grad = np.zeros_like(e)
    if not valid.any():
        return 0.0, grad
    positive, negative = np.where(same, far, -1).argmax(axis=1), np.where(other, far, np.inf).argmin(axis=1)
    gap = far[at, positive] - far[at, negative] + margin
    for partner, sign in ((positive, 1), (negative, -1)):
        away = far[at, partner]
        pull = np.where((valid & (gap > 0) & (away > 0))[:, None], sign * (e - e[partner]) / np.where(away > 0, away, 1)[:, None], 0) / valid.sum()
        grad += pull
        np.add.at(grad, partner, -pull)
    return float(np.maximum(gap[valid], 0).sum() / valid.sum()), grad


def _gated(g: Graphs, x: np.ndarray, w: Weights) -> tuple[np.ndarray, tuple]:
    m = messages(g, x)
    z, r = sigmoid(m @ w["z_in"] + x @ w["z_self"]), sigmoid(m @ w["r_in"] + x @ w["r_self"])
    new = np.maximum(m @ w["h_in"] + (r * x) @ w["h_self"], 0)
    return new * z + x * (1 - z), (x, m, z, r, new)


def _gated_back(g: Graphs, d: np.ndarray, kept: tuple, w: Weights, grads: dict[str, np.ndarray]) -> np.ndarray:
    x, m, z, r, new = kept
    dh = d * z * (new > 0)
    dz = d * (new - x) * z * (1 - z)
    dq = dh @ w["h_self"].T
    dr = dq * x * r * (1 - r)
    for gate, back, self_input in (("z", dz, x), ("r", dr, x), ("h", dh, r * x)):
        grads[f"{gate}_in"] += m.T @ back
        grads[f"{gate}_self"] += self_input.T @ back
    to_m = dz @ w["z_in"].T + dr @ w["r_in"].T + dh @ w["h_in"].T
    return d * (1 - z) + dq * r + dz @ w["z_self"].T + dr @ w["r_self"].T + messages(g, to_m)


def gradients(ids: list[np.ndarray], y: np.ndarray, w: Weights, net: Network, how: Training, window: int = WINDOW) -> tuple[float, dict[str, np.ndarray]]:
    """Loss of a batch and the gradients of all weights. A document without tokens counts with probability 0.5 and a zero
    vector, which no weight changes. Edges go both ways with one weight, so messages are their own transpose."""
    if net.conv:
        raise ValueError("convolutions are applied with given weights, not trained")
    grads = {name: np.zeros_like(x) for name, x in w.items()}
    n, sizes = len(ids), np.array([len(x) for x in ids], np.int64)
    prob, unit = np.full(n, 0.5), np.zeros((n, w["embed1"].shape[1]))
    held = bool(sizes.sum())
    if held:
        g = Graphs(np.concatenate(ids).astype(np.int64), sizes, window)
        which, starts, owner = np.unique(g.owner, return_index=True, return_inverse=True)
        features = w["table"][g.code]
        gated, kept = net.kind == "gated", []
        if gated:
            x = encoded(features, w, net)
        else:
            x = np.maximum(messages(g, features @ w["layer0"]), 0)
            first = x > 0
        for k in range(net.steps) if gated else range(1, layers(w)):
            if gated:
                new, back = _gated(g, x, w)
            else:
                new = np.maximum(messages(g, x @ w[f"layer{k}"]), 0)
                back = (x, new > 0, f"layer{k}")
            kept.append(back)
            x = x + new if net.residual else new
        soft, value = sigmoid(x @ w["attention"]), np.maximum(x @ w["value"], 0)
        y_node = soft * value
        total, most = np.add.reduceat(y_node, starts, axis=0), np.maximum.reduceat(y_node, starts, axis=0)
        graphs = {"sum": lambda: total + most, "mul": lambda: total * most, "concat": lambda: np.concatenate((total, most), axis=1)}[net.how]()
        hidden = np.tanh(graphs @ w["dense"])
        prob[which] = sigmoid(hidden @ w["out"]).ravel()
        wide = np.maximum(graphs @ w["embed0"], 0)
        vector = wide @ w["embed1"]
        length = np.linalg.norm(vector, axis=1, keepdims=True)
        safe = np.where(length > 0, length, 1)
        unit[which] = vector / safe

    # the same guard inside the logarithm as the evaluated log loss has
    plain = float(-(np.log(prob + 1e-10) * y + np.log(1 - prob + 1e-10) * (1 - y)).mean())
    contrast, d_unit = (supcon(unit, y, how.temperature) if how.loss == "supcon" else triplet(unit, y, how.margin)) if how.contrast else (0.0, np.zeros_like(unit))
    loss = (1 - how.contrast) * plain + how.contrast * contrast
    if not held:
        return loss, grads

    p, t = prob[which], y[which]
    d_score = ((1 - how.contrast) / n * (-t / (p + 1e-10) + (1 - t) / (1 - p + 1e-10)) * p * (1 - p))[:, None]
    grads["out"] += hidden.T @ d_score
    d_hidden = d_score @ w["out"].T * (1 - hidden**2)
    grads["dense"] += graphs.T @ d_hidden
    d_graphs = d_hidden @ w["dense"].T
    d_vector = how.contrast * d_unit[which]
    d_vector = np.where(length > 0, (d_vector - unit[which] * (unit[which] * d_vector).sum(axis=1, keepdims=True)) / safe, 0)
    grads["embed1"] += wide.T @ d_vector
    d_wide = d_vector @ w["embed1"].T * (wide > 0)
    grads["embed0"] += graphs.T @ d_wide
    d_graphs = d_graphs + d_wide @ w["embed0"].T

    if net.how == "concat":
        d_total, d_most = np.split(d_graphs, 2, axis=1)
    else:
        d_total, d_most = (d_graphs * most, d_graphs * total) if net.how == "mul" else (d_graphs, d_graphs)
    at_most = (y_node == most[owner]).astype(float)  # equal maxima share
    d_node = d_total[owner] + d_most[owner] * at_most / np.add.reduceat(at_most, starts, axis=0)[owner]
    d_value = d_node * soft * (value > 0)
    d_soft = (d_node * value).sum(axis=1, keepdims=True) * soft * (1 - soft)
    grads["value"] += x.T @ d_value
    grads["attention"] += x.T @ d_soft
    d = d_value @ w["value"].T + d_soft @ w["attention"].T
    for back in reversed(kept):
        if gated:
            below = _gated_back(g, d, back, w, grads)
        else:
            x_in, open_, name = back
            m = messages(g, d * open_)
            grads[name] += x_in.T @ m
            below = m @ w[name].T
        d = d + below if net.residual else below
    if gated:
        grads["encode"] += features.T @ d
        d_features = d @ w["encode"].T
        if "encode_down" in w:
            grads["encode_up"] += net.scale * (features @ w["encode_down"]).T @ d
            grads["encode_down"] += net.scale * features.T @ (d @ w["encode_up"].T)
            d_features = d_features + net.scale * (d @ w["encode_up"].T) @ w["encode_down"].T
    else:
        m = messages(g, d * first)
        grads["layer0"] += features.T @ m
        d_features = m @ w["layer0"].T
    np.add.at(grads["table"], g.code, d_features)
    return loss, grads


# ---- batches and sums over the data -------------------------------------------------------------------------

BATCH_SCHEMA = "step int, ids array<array<int>>, target array<int>"


def batches(samples: DataFrame, ids: str, label: str, how: Training) -> DataFrame:
    """step, ids, target: one row a batch of at most ``how.batch`` samples and about ``TOKENS_AT_ONCE`` tokens. Samples without a
    label take no part. Rows are dealt evenly whatever they hold, and stand in the order of a seeded hash within a task."""
    spark = samples.sparkSession
    picked = samples.select(F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"), F.col(label).cast("int").alias("target")).filter("target IS NOT NULL")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = picked.repartition(tasks).sortWithinPartitions(F.xxhash64("ids", "target", F.lit(how.seed)), "target")
    size, steps = how.batch, how.steps

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for part in rows:
            lengths = np.diff(part.column(0).offsets.to_numpy())
            begin = held = 0
            for i, n in enumerate([*lengths, None]):
                if n is None or i - begin == size or (i > begin and held + n > TOKENS_AT_ONCE):
                    if i > begin:
                        some = part.slice(begin, i - begin)
                        row = [{"step": number % steps, "ids": some.column(0).to_pylist(), "target": some.column(1).to_pylist()}]
                        yield pa.RecordBatch.from_pylist(row, pa.schema([("step", pa.int32()), ("ids", pa.list_(pa.list_(pa.int32()))), ("target", pa.list_(pa.int32()))]))
                        number += 1
                    begin, held = i, 0
                held += n or 0

    return dealt.mapInArrow(run, BATCH_SCHEMA)


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in sorted(w)])


def unflat(x: np.ndarray, like: Weights) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name in sorted(like):
        out[name] = x[at : at + like[name].size].reshape(like[name].shape)
        at += like[name].size
    return out


def added(blocks: DataFrame) -> DataFrame:
    """block, task, x: sums of blocks over tasks, in the order of tasks."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task", kind="stable")
        total = np.zeros(len(rows["x"].iloc[0]) // 8)
        for x in rows["x"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "task": [rows["task"].iloc[0]], "x": [total.tobytes()]})

    first = blocks.groupBy("block", F.pmod("task", F.lit(FIRST_SUMS))).applyInPandas(add, blocks.schema)
    return first.groupBy("block").applyInPandas(add, blocks.schema)


def mean_gradient(dealt: DataFrame, w: Weights, net: Network, how: Training, window: int = WINDOW) -> tuple[int, float, dict[str, np.ndarray]]:
    """Samples, mean loss and mean gradients over all batches, each batch weighing as many samples as it has."""
    spark, names = dealt.sparkSession, sorted(w)
    sent, n_numbers = shipped(spark, w), 2 + sum(x.size for x in w.values())

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total = sent.value, np.zeros(n_numbers)
        for part in rows:
            for i in range(part.num_rows):
                docs, target = part.column(1)[i].values, part.column(2)[i].values.to_numpy().astype(np.float64)
                ids = [docs[k].values.to_numpy() if len(docs[k]) else np.zeros(0, np.int32) for k in range(len(docs))]
                loss, grads = gradients(ids, target, weights, net, how, window)
                total[:2] += len(ids), len(ids) * loss
                at = 2
                for name in names:
                    total[at : at + grads[name].size] += len(ids) * grads[name].ravel()
                    at += grads[name].size
        task = TaskContext.get().partitionId()
        for b in range(-(-n_numbers // BLOCK)):
            x = total[b * BLOCK : (b + 1) * BLOCK]
            if x.any():  # rows of the table that no document here holds
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "task": pa.array([task], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    total = np.zeros(n_numbers)
    for row in added(dealt.select("step", "ids", "target").mapInArrow(run, "block int, task int, x binary")).collect():
        total[row.block * BLOCK : row.block * BLOCK + len(row.x) // 8] = np.frombuffer(row.x)
    sent.unpersist()
    n = int(total[0])
    return n, total[1] / max(n, 1), unflat(total[2:] / max(n, 1), w)


# ---- optimiser, epochs, checkpoints -------------------------------------------------------------------------


@dataclass
class State:
    """Weights with the optimiser's moments after ``steps`` steps."""

    weights: dict[str, np.ndarray]
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    epoch: int = 0
    accuracy: float = 0.0


def rate_at(step: int, all_steps: int, how: Training) -> float:
    """The rate of a step, from 0: up over the warm-up, then down to 0."""
    warm = all_steps * how.warmup
    return how.rate * (step / max(1.0, warm) if step < warm else max(0.0, (all_steps - step) / max(1.0, all_steps - warm)))


def adamw(s: State, grads: Weights, rate: float, how: Training) -> None:
    """One step; a gradient longer than ``most_norm`` is cut to that length."""
    g = flat(grads)
    length = float(np.linalg.norm(g))
    g = g * min(1.0, how.most_norm / (length + 1e-6))
    s.steps += 1
    s.first = 0.9 * s.first + 0.1 * g
    s.second = 0.999 * s.second + 0.001 * g * g
    w = flat(s.weights) * (1 - rate * how.decay)
    w = w - rate * (s.first / (1 - 0.9**s.steps)) / (np.sqrt(s.second / (1 - 0.999**s.steps)) + how.epsilon)
    s.weights = unflat(w, s.weights)


_NUMBERS = T.ArrayType(T.DoubleType())
STATE_SCHEMA = T.StructType().add("name", "string").add("at", "long").add("width", "long").add("w", _NUMBERS).add("first", _NUMBERS).add("second", _NUMBERS)


def _saved(spark: SparkSession, s: State) -> DataFrame:
    """A row of weights a row; its moments beside it."""
    first, second = unflat(s.first, s.weights), unflat(s.second, s.weights)
    tables = []
    for name in sorted(s.weights):
        w = s.weights[name]
        rows = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        tables.append(pa.table({"name": [name] * len(w), "at": np.arange(len(w)), "width": np.full(len(w), w.shape[1]), "w": rows(w), "first": rows(first[name]), "second": rows(second[name])}))
    return spark.createDataFrame(pa.concat_tables(tables), STATE_SCHEMA)


def _loaded(spark: SparkSession, path: str, v: versions.Version, part: str, note: dict) -> State:
    rows = versions.rows_of(spark, path, versions.Version(v.number, (part,), v.schema)).toPandas().sort_values(["name", "at"])
    tables = {name: [np.stack(x[c]) for c in ("w", "first", "second")] for name, x in rows.groupby("name")}
    weights, first, second = ({name: x[i] for name, x in tables.items()} for i in range(3))
    return State(weights, flat(first), flat(second), note["steps"], note["epoch"], note["accuracy"])


def load(spark: SparkSession, path: str, best: bool = True) -> State | None:
    """The state of the best epoch, or of the last one; None where no epoch was finished."""
    v = versions.current(spark, path)
    if v is None:
        return None
    note = v.note["best" if best else "last"]
    return _loaded(spark, path, v, note["part"], note)


def accuracy_of(samples: DataFrame, ids: str, label: str, w: Weights, net: Network, window: int = WINDOW) -> float:
    scored = graph_scores(samples.filter(F.col(label).isNotNull()), label, ids, w, window, net)
    return scored.agg(F.avg(((F.col("cls_prob") > 0.5).cast("int") == F.col("id")).cast("int"))).first()[0] or 0.0


def train(
    samples: DataFrame, valid: DataFrame, path: str, ids: str = "ids", label: str = "target", start: Weights | None = None,
    net: Network = Network(), how: Training = Training(), window: int = WINDOW, until: int | None = None,
) -> State:
    """Trains up to epoch ``until`` (all of them without) and returns the state of the best accuracy on ``valid``, the first of equals.

    ``samples``: token ids and a label of 0 or 1. Goes on after the last epoch that ``path`` holds, else begins at ``start``. The
    same rows, weights and settings give the same epochs, also where a run was broken off. Without samples the start comes back.
    """
    spark = samples.sparkSession
    s = load(spark, path, best=False)
    if s is None:
        if start is None:
            raise ValueError("weights to start from are needed where nothing was saved")
        n = sum(x.size for x in start.values())
        s = State({name: np.array(x, np.float64) for name, x in start.items()}, np.zeros(n), np.zeros(n))
    at = place(spark, "batches")
    batches(samples, ids, label, how).write.partitionBy("step").parquet(at)
    stored = spark.read.schema(BATCH_SCHEMA).parquet(at)
    present = sorted(r.step for r in stored.select("step").distinct().collect())
    if not present:
        return s
    for epoch in range(s.epoch, min(how.epochs, until if until is not None else how.epochs)):
        for step in present:
            _, _, grads = mean_gradient(stored.filter(F.col("step") == step), s.weights, net, how, window)
            adamw(s, grads, rate_at(s.steps, how.epochs * len(present), how), how)
        s.epoch, s.accuracy = epoch + 1, accuracy_of(valid, ids, label, s.weights, net, window)
        before = versions.current(spark, path)
        last = {"part": versions.write_part(_saved(spark, s), path), "epoch": s.epoch, "steps": s.steps, "accuracy": s.accuracy}
        best = before.note["best"] if before and before.note["best"]["accuracy"] >= s.accuracy else last
        versions.commit(spark, path, before, sorted({best["part"], last["part"]}), STATE_SCHEMA, note={"best": best, "last": last})
        versions.expire(spark, path, keep=1)
    return load(spark, path) or s
