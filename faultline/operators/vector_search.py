"""Nearest neighbours by cosine, and what is decided from them.

``top_k`` scores blocks of queries against blocks of vectors with one matrix product per block pair, so nothing is
broadcast and no pair becomes a row: a task gives back k rows a query. Cells prune by clusters for large indexes, losing
nothing; ``cell_index`` stores them.

Vectors that are null, empty or hold a null, NaN or infinite component take no part, neither as queries nor as neighbours;
only vectors of one length are compared; a zero vector has cosine 0 with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from ..rules import NEIGHBOURS, OVERFETCH

#: Bytes of a block of queries and of vectors; blocks are smaller, down to so many vectors, where there are few.
QUERY_BYTES, VECTOR_BYTES, FEW_VECTORS = 4 << 20, 8 << 20, 4096
#: Scores of a block that are held at once.
SCORES_AT_ONCE = 1 << 22
CELL_COUNT, PROBES, FLAT_BELOW, CENTROID_SAMPLE = 100, 10, 50_000, 20_000
FOUND = "query_id long, neighbour_id long, score double"


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull(), (F.size(v) > 0) & ~bad).otherwise(False)


def usable_vectors(df: DataFrame, id_name: str, vector_name: str, *more: Column) -> DataFrame:
    """id, v (floats or doubles, as they came), d: the rows that take part."""
    kind = "float" if df.schema[vector_name].dataType.elementType == T.FloatType() else "double"
    picked = df.select(F.col(id_name).cast("long").alias("id"), F.col(vector_name).cast(f"array<{kind}>").alias("v"), *more)
    return picked.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("d", F.size("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles, each divided by a power of two so that its largest component is near 1:
    cosines stay as they are, bit by bit, and no square overflows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.cumsum(a * b, axis=-1)[..., -1]


def _block_top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, skip_self: bool) -> list[tuple]:
    norms, q_norms = np.sqrt(_dots(v, v)), np.sqrt(_dots(q, q))
    out = []
    step, spare = max(1, SCORES_AT_ONCE // len(ids)), min(len(ids), k + 8)
    for begin in range(0, len(q), step):
        near = (q[begin : begin + step] @ v.T) / np.where(norms > 0, norms, 1)
        if skip_self:
            near[q_ids[begin : begin + step, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(near, begin):
            some = np.argpartition(-row, spare - 1)[:spare] if spare < len(ids) else np.arange(len(ids))
            last = row[some].min()
            some = np.flatnonzero((row >= last - 1e-9) & (row > -np.inf))
            scale = norms[some] * q_norms[i]
            score = np.where(scale > 0, _dots(v[some], q[i]) / np.where(scale > 0, scale, 1), 0.0)
            best = np.lexsort((ids[some], -score))[:k]
            out += [(int(q_ids[i]), int(ids[j]), float(s)) for j, s in zip(some[best], score[best], strict=True)]
    return out


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "neighbour_id", "score"])


def top_k(
    queries: DataFrame, index: DataFrame, k: int = NEIGHBOURS, id_name: str = "vec_id", vector_name: str = "embedding",
    skip_self: bool = True, query_bytes: int = QUERY_BYTES, vector_bytes: int = VECTOR_BYTES,
) -> DataFrame:
    """query_id, neighbour_id, score, rank: the ``k`` most similar rows of ``index``, ties to the smaller id."""

    def blocks(df: DataFrame, most: int, few: int) -> int:
        width = 4 if df.schema[vector_name].dataType.elementType == T.FloatType() else 8
        n, held = df.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.array_size(vector_name), F.lit(0)) * width)).first()
        cores = df.sparkSession.sparkContext.defaultParallelism
        return max(1, -(-(held or 0) // most), min(cores, n // few))

    v_blocks, q_blocks = blocks(index, vector_bytes, FEW_VECTORS), blocks(queries, query_bytes, 1 << 40)
    left = usable_vectors(queries, id_name, vector_name).select(
        F.col("id").alias("q_id"), "v", "d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("vb"),
    )
    right = usable_vectors(index, id_name, vector_name).select(
        "id", "v", "d", F.pmod(F.xxhash64("id"), F.lit(v_blocks)).cast("int").alias("vb"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"),
    )

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _found([])
        return _found(_block_top_k(a["q_id"].to_numpy(), matrix(a["v"]), b["id"].to_numpy(), matrix(b["v"]), k, skip_self))

    found = left.groupBy("d", "qb", "vb").cogroup(right.groupBy("d", "qb", "vb")).applyInArrow(cell, FOUND)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_metadata(neighbours: DataFrame, meta: DataFrame, id_name: str = "vec_id") -> DataFrame:
    """Adds the neighbours' columns; a neighbour that is not in ``meta`` keeps nulls."""
    return neighbours.join(meta, neighbours["neighbour_id"] == meta[id_name], "left").drop(id_name)


def label_fraction(neighbours: DataFrame, queries: DataFrame, label: str = "label", id_name: str = "vec_id") -> DataFrame:
    """query_id, faiss_score: the share of neighbours labelled 1; 0.5 for a query without neighbours."""
    share = neighbours.groupBy("query_id").agg(F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("faiss_score"))
    every = queries.select(F.col(id_name).alias("query_id"))
    return every.join(share, "query_id", "left").withColumn("faiss_score", F.coalesce("faiss_score", F.lit(0.5)))


def majority_type(neighbours: DataFrame, queries: DataFrame, label: str = "label", kind: str = "vuln_type", id_name: str = "vec_id") -> DataFrame:
    """query_id, vuln_type, confidence: the type most vulnerable neighbours have, ties to the one met first."""
    typed = neighbours.filter((F.col(label) == 1) & F.col(kind).isNotNull() & (F.col(kind) != ""))
    votes = typed.groupBy("query_id", kind).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    best = votes.groupBy("query_id").agg(
        F.max_by(kind, F.struct("n", -F.col("first"))).alias("vuln_type"), (F.max("n") / F.sum("n")).alias("confidence")
    )
    every = queries.select(F.col(id_name).alias("query_id"))
    return every.join(best, "query_id", "left").select(
        "query_id", F.coalesce("vuln_type", F.lit("unknown")).alias("vuln_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


def retrieve(neighbours: DataFrame, wanted: F.Column, k: int) -> DataFrame:
    """First ``k`` of already ranked rows that satisfy ``wanted``: filtering comes after the over-fetched ranking."""
    order = Window.partitionBy("query_id").orderBy("rank")
    kept = neighbours.filter(wanted).withColumn("rank", F.row_number().over(order))
    return kept.filter(F.col("rank") <= k)


def retrieve_postfilter(queries: DataFrame, index: DataFrame, meta: DataFrame, wanted: F.Column, k: int, overfetch: int = OVERFETCH) -> DataFrame:
    return retrieve(with_metadata(top_k(queries, index, k * overfetch), meta), wanted, k)


# ---- cluster cells ------------------------------------------------------------------------------------------


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def k_means(data: np.ndarray, centres: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit rows from given centres."""
    centres = centres.copy()
    for _ in range(rounds):
        best = np.argmax(data @ centres.T, axis=1)
        for c in range(len(centres)):
            total = data[best == c].sum(axis=0)
            if np.linalg.norm(total) > 1e-12:
                centres[c] = total / np.linalg.norm(total)
    return centres


@dataclass
class Cells:
    """Clusters: their ids, unit centres, how many vectors each holds, and the least cosine of one with its centre."""

    ids: np.ndarray
    centres: np.ndarray
    sizes: np.ndarray
    least: np.ndarray

    @classmethod
    def around(cls, centres: np.ndarray) -> Cells:
        n = len(centres)
        return cls(np.arange(n), centres, np.zeros(n, np.int64), np.ones(n))

    @property
    def d(self) -> int:
        return self.centres.shape[1] if len(self.ids) else 0

    def nearest(self, n: int) -> Callable:
        """A function of a vector column: the ids of its ``n`` nearest cells, and its cosine with the first."""
        ids, centres = self.ids, self.centres

        @F.pandas_udf("struct<cells:array<int>,cosine:double>")
        def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for v in batches:
                near = _units(np.stack(v.to_numpy()).astype(np.float64)) @ centres.T if len(v) else np.zeros((0, len(ids)))
                order = np.argsort(-near, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"cells": list(ids[order].astype(np.int32)), "cosine": near.max(axis=1) if len(v) else []})

        return place

    def others(self, probes: int) -> Callable:
        """A function of vector and k-th score: ids of the cells beyond the ``probes`` nearest that may hold a better one."""
        ids, centres = self.ids, self.centres
        radius = np.where(self.sizes > 0, np.arccos(np.clip(self.least, -1, 1)), -np.inf)

        @F.pandas_udf("array<int>")
        def reach(v: pd.Series, floor: pd.Series) -> pd.Series:
            rows = np.stack(v.to_numpy()).astype(np.float64)
            near, zero = _units(rows) @ centres.T, ~rows.any(axis=1)
            angle = np.arccos(np.clip(near, -1, 1))
            bound = np.where(np.isinf(radius), -np.inf, np.cos(np.maximum(angle - radius, 0)))
            bound[zero] = np.inf
            order = np.argsort(-near, axis=1, kind="stable")[:, probes:]
            least = floor.to_numpy() - 1e-6  # more than arccos and cos lose
            return pd.Series([ids[o[b[o] >= x]].astype(np.int32) for o, b, x in zip(order, bound, least, strict=True)])

        return reach

    def count(self, placed: DataFrame) -> None:
        """Takes in vectors that were placed (cell, cosine): two numbers a cell come to the driver."""
        at = {c: i for i, c in enumerate(self.ids.tolist())}
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect():
            i = at[r.cell]
            self.sizes[i] += r.n
            self.least[i] = min(self.least[i], r.least)


def placed(rows: DataFrame, cells: Cells) -> DataFrame:
    """Adds the nearest cell of each vector ``v`` and the cosine with its centre."""
    found = rows.withColumn("near", cells.nearest(1)("v"))
    return found.withColumns({"cell": F.get("near.cells", 0), "cosine": F.col("near.cosine")}).drop("near")


def fit_cells(index: DataFrame, cells: int = CELL_COUNT, sample: int = CENTROID_SAMPLE, vector_name: str = "embedding", id_name: str = "vec_id", rounds: int = 10) -> np.ndarray:
    """Unit centres by spherical k-means over at most ``sample`` usable vectors, those a hash of the id puts first; of
    vectors of several lengths, the most frequent there."""
    drawn = usable_vectors(index, id_name, vector_name).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    if not drawn:
        return np.zeros((0, 0))
    lengths = pd.Series([len(r.v) for r in drawn]).value_counts()
    d = min(lengths[lengths == lengths.max()].index)
    data = _units(np.array([r.v for r in drawn if len(r.v) == d], dtype=np.float64))
    return k_means(data, data[np.linspace(0, len(data) - 1, min(cells, len(data))).astype(int)], rounds)


def search_cells(
    queries: DataFrame, members: Callable[[list[int]], DataFrame], cells: Cells, k: int = NEIGHBOURS, probes: int = PROBES,
    probes_only: bool = False, vector_bytes: int = VECTOR_BYTES, skip_self: bool = True,
) -> DataFrame:
    """The k nearest of each query (id, v): from the ``probes`` cells nearest to it, then from every other cell whose widest
    angle does not exclude a score better than the k-th found. ``members`` gives the rows (id, v, cell) of some cells.

    A crowded cell is dealt over parts by bytes. What cells are asked for comes to the driver, one number a cell.
    """
    session = queries.sparkSession
    width = 8 * max(cells.d, 1)
    parts_of = {int(c): int(-(-n * width // vector_bytes)) for c, n in zip(cells.ids, cells.sizes, strict=True) if n}
    if not parts_of:
        return ranked(session.createDataFrame([], FOUND), k)
    parts = F.element_at(F.create_map(*[F.lit(x) for kv in parts_of.items() for x in kv]), F.col("cell"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _found([])
        v, ids, found = matrix(b["v"]), b["id"].to_numpy(), []
        step = max(1, QUERY_BYTES // (8 * v.shape[1]))
        for at in range(0, len(a), step):
            some = a.slice(at, step)
            found += _block_top_k(some["q_id"].to_numpy(), matrix(some["v"]), ids, v, k, skip_self)
        return _found(found)

    def searched(asked: DataFrame) -> DataFrame:
        asked = asked.filter(F.col("cell").isin(*parts_of))
        wanted = [r.cell for r in asked.select("cell").distinct().collect()]
        left = asked.select(F.col("id").alias("q_id"), "v", "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        right = members(wanted).select("id", "v", "cell").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(cell, FOUND)

    found = ranked(searched(queries.withColumn("cell", F.explode(cells.nearest(probes)("v")["cells"]))), k)
    if probes_only:
        return found
    found = cut(found, "probed")
    floors = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).filter(F.col("n") >= k)
    asked = queries.join(floors.select(F.col("query_id").alias("id"), "last"), "id", "left").withColumn("last", F.coalesce("last", F.lit(-2.0)))
    more = searched(asked.select("id", "v", F.explode(cells.others(probes)("v", "last")).alias("cell")))
    return ranked(found.drop("rank").union(more), k)


def top_k_cells(
    queries: DataFrame, index: DataFrame, k: int = NEIGHBOURS, cells: int = CELL_COUNT, probes: int = PROBES,
    id_name: str = "vec_id", vector_name: str = "embedding", flat_below: int = FLAT_BELOW, probes_only: bool = False,
) -> DataFrame:
    """As ``top_k``, over cells that are fitted for this one search.

    ``probes_only`` stops after the nearest cells: the reference's approximate search, with rows and neighbours missing. A
    small index is searched whole, as are vectors of another length than the cells'.
    """
    if index.count() < flat_below:
        return top_k(queries, index, k, id_name, vector_name)
    known = Cells.around(fit_cells(index, cells, id_name=id_name, vector_name=vector_name))
    if not known.d:
        return top_k(queries, index, k, id_name, vector_name)
    rows = placed(usable_vectors(index, id_name, vector_name).filter(F.col("d") == known.d), known)
    known.count(rows)
    asked = usable_vectors(queries, id_name, vector_name)
    found = search_cells(asked.filter(F.col("d") == known.d), lambda wanted: rows.filter(F.col("cell").isin(*wanted)), known, k, probes, probes_only)
    if asked.filter(F.col("d") != known.d).isEmpty():
        return found
    other = F.size(vector_name) != known.d
    return found.unionByName(top_k(queries.filter(other), index.filter(other), k, id_name, vector_name))


def types(index: DataFrame, kind: str = "vuln_type") -> DataFrame:
    """The distinct types an index knows."""
    return index.filter(F.col(kind).isNotNull() & (F.col(kind) != "")).select(kind).distinct()


def of_type(index: DataFrame, wanted: str, kind: str = "vuln_type") -> DataFrame:
    return index.filter(F.col(kind) == wanted)
