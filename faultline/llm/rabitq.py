"""Nearest neighbours by randomly rotated one-bit codes.

Index. A vector is scaled to unit length and turned by a seeded random rotation; its code is the sign bit of each
coordinate, packed, with one correction scalar: the inner product ``s`` of the turned vector with its own code.

Search. For a query turned the same way, ``<code, query> / s`` estimates the cosine without bias, and the error
stays below ``SURE * sqrt((1 - s^2) / s^2 / (d - 1))`` with high probability. The best ``FIRST`` estimates are
reranked on the original vectors; after that a vector is reranked only if its estimate plus its bound reaches the
k-th exact score so far. Ranks and scores come from original vectors alone, in double precision.

At scale. Queries and vectors are dealt into blocks by hash, and a task scores one block of queries against one block
of vectors, so neither side is ever broadcast and a task's memory is set by the bytes of a block. Each task returns k
rows a query. A vector travels once per block of queries, in the width it came in and with its code, so that nothing is
fetched for reranking. Every row is indexed; no sample is fitted, the rotation depends on the dimension and a seed only.

Defined cases: vectors that are null, empty, all zero or hold a null, NaN or infinite component take no part, neither
do rows with null vec_id; components of any finite size count, as cosines are taken after a scaling by powers of two; only
vectors of one length are compared; rows that repeat a vec_id and vector count once (of queries that share a vec_id one is
asked), and a row with the query's own vec_id is never its neighbour; fewer
candidates than k give fewer rows; ties go to the smaller vec_id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

K, EVERY = 5, 50
SURE, FIRST, SEED = 3.0, 48, 20240
#: Vectors travel once per block of queries and queries once per block of vectors; steps inside a block bound memory.
QUERY_BYTES, VECTOR_BYTES, ESTIMATED_AT_ONCE, RERANKED_AT_ONCE = 16 << 20, 8 << 20, 64, 65536
#: Blocks smaller than their bytes allow, down to this many vectors, where there would be too few for all cores.
FEW_VECTORS = 4096


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    """A seeded orthogonal matrix of the Haar distribution."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows as doubles, each divided by a power of two so that its largest component is near 1. Nothing is rounded."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes, correction scalars) of rows of ``vectors``."""
    d = vectors.shape[1]
    unit = scaled(vectors)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ rotation(d)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(d)


def signs_of(codes: np.ndarray, scalars: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs over scalars and the root of ``d``, error bounds) of packed codes."""
    bound = SURE * np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars / np.sqrt(max(d - 1, 1))
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32)
    signs *= 2
    signs -= 1
    signs /= (scalars * np.sqrt(d)).astype(np.float32)[:, None]
    return signs, bound.astype(np.float32)


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines as query x vector, error bound per vector) for unit queries."""
    signs, bound = signs_of(codes, scalars, queries.shape[1])
    return (queries @ rotation(queries.shape[1])).astype(np.float32) @ signs.T, bound


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, components added from first to last."""
    return np.cumsum(a * b, axis=-1)[..., -1]


def search_block(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query, vec_id, score) of the k nearest of one block for each query; ``queries`` are scaled."""
    signs, bound = signs_of(codes, scalars, queries.shape[1])
    vectors = scaled(vectors)
    norms, q_norms = np.sqrt(dots(vectors, vectors)), np.sqrt(dots(queries, queries))
    out = []
    for begin in range(0, len(queries), ESTIMATED_AT_ONCE):
        some = slice(begin, begin + ESTIMATED_AT_ONCE)
        turned = (queries[some] / q_norms[some, None]) @ rotation(queries.shape[1])
        guess = turned.astype(np.float32) @ signs.T
        for q_id, q, q_norm, near in zip(q_ids[some], queries[some], q_norms[some], guess, strict=True):
            near[ids == q_id] = -np.inf
            out += rerank(ids, vectors, norms, near, bound, q_id, q, q_norm, k)
    return out


def rerank(ids, vectors, norms, near, bound, q_id, q, q_norm, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of one query: exact scores of the best estimates, then of all whose bound reaches the k-th of them."""
    n = int(np.isfinite(near).sum())
    if not n:
        return []

    def exact(at: np.ndarray) -> np.ndarray:
        return dots(vectors[at], q) / (norms[at] * q_norm)

    found = np.argpartition(-near, min(FIRST, n) - 1)[: min(FIRST, n)]
    score = exact(found)
    if n > len(found):
        floor = np.sort(score)[-k] if k <= len(score) else -np.inf
        near[found] = -np.inf
        more = np.flatnonzero(near + bound >= floor - 1e-6)
        for at in range(0, len(more), RERANKED_AT_ONCE):
            part = more[at : at + RERANKED_AT_ONCE]
            found, score = np.concatenate((found, part)), np.concatenate((score, exact(part)))
            best = np.lexsort((ids[found], -score))[:k]
            found, score = found[best], score[best]
    best = np.lexsort((ids[found], -score))[:k]
    return [(int(q_id), int(ids[i]), float(s)) for i, s in zip(found[best], score[best], strict=True)]


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def index(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """vec_id, d, v (bytes of floats or doubles, as they came), code, scalar: every usable row, in Arrow batches."""
    element = vectors.schema[vector_name].dataType.elementType
    kind, width = ("float", np.float32) if element == T.FloatType() else ("double", np.float64)
    # one expression, so that no element of an unusable vector is looked at outside it
    picked = vectors.select(F.col(id_name).cast("long").alias("vec_id"), F.col(vector_name).cast(f"array<{kind}>").alias("v"))
    picked = picked.filter(F.col("vec_id").isNotNull() & F.when(F.col("v").isNotNull(), usable(F.col("v"))).otherwise(False))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(width, copy=False)
            starts = np.cumsum(sizes) - sizes
            codes: list = [b""] * len(sizes)
            scalars = np.zeros(len(sizes))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                some, s = encode(flat[starts[at][:, None] + np.arange(d)])
                scalars[at] = s
                for i, c in zip(at, some, strict=True):
                    codes[i] = c.tobytes()
            raw = [flat[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)]
            columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary()), pa.array(codes, pa.binary()), pa.array(scalars)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "d", "v", "code", "scalar"])

    return picked.mapInArrow(run, "vec_id long, d int, v binary, code binary, scalar double")


def nearest(
    vectors: DataFrame, id_name: str = "vec_id", vector_name: str = "embedding", every: int = EVERY, k: int = K,
    query_bytes: int = QUERY_BYTES, vector_bytes: int = VECTOR_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its ``k`` nearest other rows."""
    width = np.float32 if vectors.schema[vector_name].dataType.elementType == T.FloatType() else np.float64
    size = F.coalesce(F.array_size(vector_name), F.lit(0)) * np.dtype(width).itemsize
    asks = F.col(id_name) % every == 0
    total, held, asked = vectors.agg(F.count(F.lit(1)), F.sum(size), F.sum(F.when(asks, size))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    v_blocks = max(1, -(-(held or 0) // vector_bytes), min(cores, -(-total // FEW_VECTORS)))
    q_blocks = max(1, -(-(asked or 0) // query_bytes))
    indexed = index(vectors, id_name, vector_name)
    queries = indexed.filter(F.col("vec_id") % every == 0).select("vec_id", "d", "v")
    if not vectors.groupBy(F.col(id_name).cast("long")).count().filter("count > 1").isEmpty():
        indexed = indexed.dropDuplicates(["vec_id", "d", "v"])
        queries = queries.groupBy("vec_id").agg(F.min(F.struct("d", "v")).alias("q")).select("vec_id", "q.d", "q.v")
    sides = [
        indexed.withColumn("vb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(v_blocks)).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))),
        queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int"))
        .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1)))),
    ]

    def rows(column: pa.ChunkedArray, kind) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(left) and len(right):
            found = search_block(
                left["vec_id"].to_numpy(), rows(left["v"], width), rows(left["code"], np.uint8), left["scalar"].to_numpy(),
                right["vec_id"].to_numpy(), scaled(rows(right["v"], width)), k,
            )
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    keys = ["d", "vb", "qb"]
    found = sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op3_rabitq(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: Brute force over every pair of a query and a row.
OP3_SQL = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT vec_id, v, pow(2::DOUBLE, floor(log2(list_max(list_transform(v, lambda x: abs(x)))))) AS top FROM e),
u AS (SELECT vec_id, list_transform(v, lambda x: x / top) AS v FROM p),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM u),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(c.v, q.v) / (c.norm * q.norm) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= {K}"""
