"""Token graphs: sliding-window edges, weights, normalisation, one hop of message passing, pooling.

A document's graph lies wholly in its own row, so ``token_edges``, ``token_nodes`` and ``token_hop`` build it there, in
Arrow batches with numpy over many documents at once: nothing is exchanged, however many edges there are. ``degrees``,
``normalized`` and ``hop`` do the same steps for edge tables that come from elsewhere, with joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, TOKENS_AT_ONCE = 3, 500_000


class Graphs:
    """The graphs of several documents: ``nodes`` (document, token number) and edges in both directions."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, window: int) -> None:
        n_codes = int(codes.max()) + 1 if len(codes) else 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        length = np.repeat(sizes, sizes)
        nodes, self.first, node = np.unique(owner * n_codes + codes, return_index=True, return_inverse=True)
        self.owner, self.code = nodes // n_codes, nodes % n_codes
        pairs, held = [], []
        for d in range(1, window):
            p = np.flatnonzero(place >= d)
            p = p[codes[p] != codes[p - d]]
            q = p - d
            pairs.append(np.minimum(node[p], node[q]) * len(nodes) + np.maximum(node[p], node[q]))
            # windows around both begin from max(p - w + 1, 0) to min(q, n - w); a short document is one window
            spread = np.minimum(place[q], length[p] - window) - np.maximum(place[p] - window + 1, 0) + 1
            held.append(np.where(length[p] <= window, 1, spread))
        key, at = np.unique(np.concatenate(pairs), return_inverse=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        count = np.bincount(at, weights=np.concatenate(held), minlength=len(key)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        low, high = key // max(len(nodes), 1), key % max(len(nodes), 1)
        self.src, self.dst = np.concatenate((low, high)), np.concatenate((high, low))
        self.windows = np.concatenate((count, count))
        self.degree = np.bincount(self.src, minlength=len(nodes)).astype(np.float64)
        self.norm = 1.0 / np.sqrt(self.degree[self.src] * self.degree[self.dst])


def batched(docs: DataFrame, id_name: str, columns: list[Column], schema: str, emit) -> DataFrame:
    """``emit(graph input, ids, words)`` per run of documents of about ``TOKENS_AT_ONCE`` tokens."""
    picked = docs.select(F.col(id_name).alias("id"), *columns)
    names = ["id", *[f.split()[0] for f in schema.split(", ")]]
    fields = f"id {picked.schema[0].dataType.simpleString()}, {schema}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            begin = held = 0
            for i, n in enumerate([*sizes, None]):
                if n is None or (i > begin and held + n > TOKENS_AT_ONCE):
                    part = batch.slice(begin, i - begin)
                    words = part.column(1).flatten().dictionary_encode()
                    at, arrays = emit(words, sizes[begin:i], part)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *arrays], names=names)
                    begin, held = i, 0
                held += n or 0

    return picked.mapInArrow(run, fields)


def _graphs(words: pa.DictionaryArray, sizes: np.ndarray, window: int) -> Graphs:
    return Graphs(words.indices.to_numpy().astype(np.int64), sizes.astype(np.int64), window)


def token_edges(docs: DataFrame, id_name: str, tokens: str, window: int = WINDOW) -> DataFrame:
    """id, src, dst, w, windows, norm: different tokens that share a window, in both directions.

    ``w`` is 1, ``windows`` how many windows hold the two at different positions, ``norm`` w over the roots of both
    degrees. Null and empty token arrays have no edges.
    """

    def emit(words, sizes, part):
        g = _graphs(words, sizes, window)
        text = words.dictionary
        return g.owner[g.src], [
            text.take(pa.array(g.code[g.src])), text.take(pa.array(g.code[g.dst])), pa.array(np.ones(len(g.src))), pa.array(g.windows), pa.array(g.norm),
        ]

    return batched(docs, id_name, [F.col(tokens)], "src string, dst string, w double, windows long, norm double", emit)


def position_edges(docs: DataFrame, id_name: str, tokens: str, window: int = WINDOW) -> DataFrame:
    """id, src, dst, w: every place of a token array is a node (from 0), also where tokens are equal; places less than
    ``window`` apart are joined in both directions. Null and empty arrays have no edges."""
    n = F.coalesce(F.size(tokens), F.lit(0))
    far = docs.select(F.col(id_name).alias("id"), n.alias("n"), F.explode(F.sequence(F.lit(1), F.lit(window - 1))).alias("d")).filter("n > d")
    near = far.select("id", "d", F.explode(F.sequence(F.col("d"), F.col("n") - 1)).alias("p"))
    ends = F.array(F.struct(F.col("p").alias("src"), (F.col("p") - F.col("d")).alias("dst")), F.struct((F.col("p") - F.col("d")).alias("src"), F.col("p").alias("dst")))
    return near.select("id", F.explode(ends).alias("e")).select("id", "e.src", "e.dst", F.lit(1.0).alias("w"))


def token_nodes(docs: DataFrame, id_name: str, tokens: str, window: int = WINDOW) -> DataFrame:
    """id, node, degree: every token that has a neighbour."""

    def emit(words, sizes, part):
        g = _graphs(words, sizes, window)
        linked = np.flatnonzero(g.degree)
        return g.owner[linked], [words.dictionary.take(pa.array(g.code[linked])), pa.array(g.degree[linked])]

    return batched(docs, id_name, [F.col(tokens)], "node string, degree double", emit)


def token_hop(docs: DataFrame, id_name: str, tokens: str, values: str, window: int = WINDOW) -> DataFrame:
    """id, node, x: relu of the normalised sum of the neighbours' values; ``values`` runs beside ``tokens``, a token's
    value being that of its first place."""

    def emit(words, sizes, part):
        g = _graphs(words, sizes, window)
        value = part.column(2).flatten().to_numpy(zero_copy_only=False)[g.first]
        total = np.bincount(g.src, weights=g.norm * value[g.dst], minlength=len(g.code))
        linked = np.flatnonzero(g.degree)
        return g.owner[linked], [words.dictionary.take(pa.array(g.code[linked])), pa.array(np.maximum(total[linked], 0.0))]

    return batched(docs, id_name, [F.col(tokens), F.col(values).cast("array<double>")], "node string, x double", emit)


# ---- the same steps for edge tables -------------------------------------------------------------------------


def degrees(edge: DataFrame) -> DataFrame:
    return edge.groupBy("id", "src").agg(F.sum("w").alias("degree"))


def normalized(edge: DataFrame) -> DataFrame:
    """id, src, dst, w divided by the roots of both degrees."""
    by_src = degrees(edge)
    by_dst = by_src.select("id", F.col("src").alias("dst"), F.col("degree").alias("to_degree"))
    out = edge.join(by_src, ["id", "src"]).join(by_dst, ["id", "dst"])
    return out.select("id", "src", "dst", (F.col("w") / F.sqrt(F.col("degree") * F.col("to_degree"))).alias("w"))


def hop(norm: DataFrame, features: DataFrame) -> DataFrame:
    """id, node, x: relu of the weighted sum of neighbours' features (``features``: id, node, x)."""
    near = features.select("id", F.col("node").alias("dst"), "x")
    return norm.join(near, ["id", "dst"]).groupBy("id", F.col("src").alias("node")).agg(F.greatest(F.sum(F.col("w") * F.col("x")), F.lit(0.0)).alias("x"))


def pool(nodes: DataFrame, how: str = "mul") -> DataFrame:
    """id, graph: per graph the sum and the maximum of node values, combined by ``sum``, ``mul`` or ``concat``."""
    both = nodes.groupBy("id").agg(F.sum("x").alias("s"), F.max("x").alias("m"))
    return both.select("id", {"sum": F.col("s") + F.col("m"), "mul": F.col("s") * F.col("m"), "concat": F.array("s", "m")}[how].alias("graph"))
