"""Hard negatives through a pivot table.

Space. Entries become ``floor(256 * x)``, so scores are whole-number inner products. A vector is augmented by
``sqrt(M - |v|^2)``, M the largest squared length of all, and an anchor by 0: the squared distance of the two is then
``M + |q|^2 - 2 <q, v>``, so the largest inner product is the smallest distance.

Pivot table. ``PIVOTS`` augmented vectors, picked by farthest-first from a sample of at most ``PIVOT_SAMPLE`` vectors, and
the distance of every vector to each, stored with the vector in a table in the shared folder. By the triangle inequality
``|d(q, p) - d(v, p)| <= d(q, v) <= d(q, p) + d(v, p)``, each pivot brackets a distance, and all together a score.

Search. Anchors are taken in blocks against blocks of vectors; in a task, vectors lie ordered by their nearest pivot, in
runs whose least and largest pivot distances bracket all of them at once. A run, then a pair, is left out when its
bracket lies outside the scores asked for or below the ones already found; what survives gets its exact inner product.
The first search finds each anchor's positives, the second, within the window of scores that each positive opens, its
negatives. Every vector is in the table; the sample only chooses pivots, so it changes the work and never the result.

At scale. Nothing is broadcast but the pivots (``PIVOTS`` vectors); a task holds one block of each side by bytes and
returns at most k rows an ask. Blocks come from a hash of the row, so labels and their sizes do not matter.

Defined cases: rows with a null vec_id, a null label, a vector that is null, empty or holds a null, NaN or infinite entry
take no part, nor do vectors of a squared length of ``LARGEST`` or more, whose scores would not fit; rows that repeat vec_id,
label and vector count once; of anchors that share a vec_id the one of least length, label and vector asks; a row with the anchor's own
vec_id is never its positive or negative; only vectors of one length are compared; ties go to the smaller vec_id; an anchor
without positives, or a positive whose window holds nothing, gives no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import table

SCALE, EVERY, SHIFTED, CLASSES = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Squared lengths stay below this, so that a hundred times a score fits a LONG.
LARGEST = float(1 << 56)
PIVOTS, PIVOT_SAMPLE, SEED = 8, 2000, 31
QUERY_BYTES, VECTOR_BYTES, FEW_VECTORS = 4 << 20, 8 << 20, 4096
#: Anchors looked at together, and vectors of a run.
TOGETHER, RUN = 64, 1024
#: Relative slack of brackets: far more than rounding of squares, roots and sums.
SLACK = 1e-11


# ---- pivots and brackets ------------------------------------------------------------------------------------


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more entry that brings them to squared length ``most``."""
    vectors = vectors.astype(np.float64)
    rest = np.maximum(most - (vectors * vectors).sum(axis=1), 0)
    return np.column_stack((vectors, np.sqrt(rest)))


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it."""
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each point to each pivot."""
    return np.sqrt(np.stack([((points - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def brackets(to_query: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) scores of queries x vectors whose pivot distances lie from ``low`` to ``high``; ``base`` is
    ``M + |q|^2`` of each query. The slack covers rounding."""
    near = np.zeros((len(to_query), len(low)))
    far = np.full((len(to_query), len(low)), np.inf)
    for p in range(to_query.shape[1]):
        own = to_query[:, p, None]
        np.maximum(near, own - high[None, :, p], out=near)
        np.maximum(near, low[None, :, p] - own, out=near)
        np.minimum(far, own + high[None, :, p], out=far)
    slack = SLACK * base[:, None] + 1e-6
    return (base[:, None] - far * far) / 2 - slack, (base[:, None] - near * near) / 2 + slack


# ---- search in a task ---------------------------------------------------------------------------------------


class Block:
    """Vectors of one block, ordered by nearest pivot, in runs with the range of their pivot distances."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, stored: np.ndarray) -> None:
        nearest = stored.argmin(axis=1)
        order = np.lexsort((stored[np.arange(len(stored)), nearest], nearest))
        self.ids, self.labels, self.vectors, self.stored = ids[order], labels[order], vectors[order], stored[order]
        self.starts = np.arange(0, len(ids), RUN)
        self.low = np.minimum.reduceat(self.stored, self.starts)
        self.high = np.maximum.reduceat(self.stored, self.starts)

    def run(self, r: int) -> slice:
        return slice(self.starts[r], self.starts[r] + RUN)


class Best:
    """The k best (score, id) an ask has met, and the score that a further one has to reach."""

    def __init__(self, k: int, asks: int) -> None:
        self.k = k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * asks
        self.floor = np.full(asks, -np.inf)

    def meet(self, ask: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            some = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[some], ids[some]
        scores, ids = np.concatenate((self.found[ask][0], scores)), np.concatenate((self.found[ask][1], ids))
        best = np.lexsort((ids, -scores))[: self.k]
        self.found[ask] = scores[best], ids[best]
        if len(best) == self.k:
            self.floor[ask] = scores[best[-1]]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can reach 2^53, else in whole numbers."""
    a, b = queries.astype(np.float64), vectors.astype(np.float64)
    reach = np.sqrt((a * a).sum(axis=1).max() * (b * b).sum(axis=1).max())
    if reach < float(1 << 52):
        return (a @ b.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def search(block: Block, q_ids, q_labels, queries, to_query, base, asks: list[list[tuple[int, int]]], same: bool, k: int) -> list[list[tuple]]:
    """For each query and each of its asks (least and largest score), the k best (score, id) of the block: of rows
    with the query's label if ``same``, of the others if not."""
    out: list[list[tuple]] = []
    for begin in range(0, len(queries), TOGETHER):
        some = np.arange(begin, min(begin + TOGETHER, len(queries)))
        owner = np.concatenate([np.full(len(asks[q]), q - begin) for q in some])
        windows = np.array([w for q in some for w in asks[q]], dtype=np.int64).reshape(-1, 2)
        best = Best(k, len(owner))
        run_least, run_most = brackets(to_query[some], block.low, block.high, base[some])
        for r in np.argsort(-run_most.max(axis=0)):
            wanted = np.maximum(windows[:, 0], best.floor)
            live = (run_most[owner, r] >= wanted) & (run_least[owner, r] <= windows[:, 1])
            if not live.any():
                continue
            own = block.run(r)
            least, most = brackets(to_query[some], block.stored[own], block.stored[own], base[some])
            left = (most[owner] >= wanted[:, None]) & (least[owner] <= windows[:, 1, None]) & live[:, None]
            left &= (block.labels[own][None, :] == q_labels[some][owner][:, None]) == same
            left &= block.ids[own][None, :] != q_ids[some][owner][:, None]
            rows, columns = np.unique(owner[left.any(axis=1)]), np.flatnonzero(left.any(axis=0))
            if not len(columns):
                continue
            score = products(queries[some[rows]], block.vectors[own][columns])
            place, ids = np.searchsorted(rows, owner), block.ids[own][columns]
            for ask in np.flatnonzero(left.any(axis=1)):
                s = score[place[ask]]
                hit = left[ask, columns] & (s >= windows[ask, 0]) & (s <= windows[ask, 1]) & (s >= best.floor[ask])
                if hit.any():
                    best.meet(ask, s[hit], ids[hit])
        at = 0
        for q in some:
            for _ in asks[q]:
                out.append([(int(s), int(i)) for s, i in zip(*best.found[at], strict=True)])
                at += 1
    return out


# ---- the operator -------------------------------------------------------------------------------------------


def whole_numbers(v: Column, scale: int = SCALE) -> Column:
    """The floors of a usable vector's entries times ``scale`` as INT, else null."""
    v = v.cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c))
    floors = F.transform(v, lambda c: F.floor(c * scale).cast("double"))
    length = F.aggregate(v, F.lit(0.0), lambda s, c: s + F.pow(c * scale, 2))  # an infinite entry makes it infinite
    fits = F.aggregate(floors, F.lit(0.0), lambda s, c: s + c * c) < LARGEST
    return F.when(v.isNotNull() & (F.size(v) > 0), F.when(~odd, F.when(length < 4 * LARGEST, F.when(fits, floors.cast("array<int>")))))


def shifted_label(label: Column, vec_id: Column) -> Column:
    """Every seventh row bears the next label: mistakes that the mining has to live with."""
    return F.when(vec_id % SHIFTED == 0, (label + 1) % CLASSES).otherwise(label)


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> tuple[DataFrame, float]:
    """(vec_id, label, d, x, stored, squared; the largest squared length) of vec_id, label and x rows: ``x`` and the
    distances to the pivots as bytes."""
    squared = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = vectors.select("vec_id", "label", "x", F.size("x").alias("d"), squared.alias("squared"))
    most = rows.agg(F.max("squared")).first()[0] or 0.0
    drawn = rows.orderBy(F.xxhash64("vec_id", "label", F.lit(SEED)), "vec_id", "label", "x").limit(sample).select("d", "x").collect()
    by_length = {}
    for d in sorted({r.d for r in drawn}):
        by_length[d] = farthest_first(augmented(np.array([r.x for r in drawn if r.d == d]), most), pivots)

    def measured(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes, flat = np.diff(np.asarray(lists.offsets)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            starts = np.cumsum(sizes) - sizes
            raw, stored = [b""] * len(sizes), [b""] * len(sizes)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                own = flat[starts[at][:, None] + np.arange(d)]
                points = augmented(own, most)
                # a length the sample lacks has no pivot of its own; the origin brackets by lengths alone
                far = distances(points, by_length.get(int(d), np.zeros((1, d + 1))))
                for i, v, f in zip(at, own, far, strict=True):
                    raw[i], stored[i] = v.tobytes(), f.tobytes()
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(raw, pa.binary()), pa.array(stored, pa.binary()), batch.column(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "d", "x", "stored", "squared"])

    found = rows.mapInArrow(measured, "vec_id long, label long, d int, x binary, stored binary, squared double")
    return cut(found, "pivots"), most, by_length


def _asked(queries: DataFrame, index: DataFrame, most: float, by_length: dict, same: bool, k: int, query_bytes: int, vector_bytes: int) -> DataFrame:
    """anchor_id, ask (the positive's id and score, zeros if ``same``), score, vec_id: the best k of each block and ask.
    ``queries`` has vec_id, label, d, x, squared and asks, an array of (positive_id, positive_score)."""
    session = index.sparkSession
    per_row = F.length("x") + F.length("stored") + 24
    total, held = index.agg(F.count(F.lit(1)), F.sum(per_row)).first()
    asked = queries.agg(F.sum(F.length("x") + 24)).first()[0]
    v_blocks = max(1, -(-(held or 0) // vector_bytes), min(session.sparkContext.defaultParallelism, -(-total // FEW_VECTORS)))
    q_blocks = max(1, -(-(asked or 0) // query_bytes))
    left = index.select(
        "vec_id", "label", "d", "x", "stored", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(v_blocks)).cast("int").alias("vb"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"),
    )
    right = queries.select(
        F.col("vec_id").alias("q_id"), "label", "d", "x", "squared", "asks", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("vb"),
    )

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(a) and len(b):
            block = Block(a["vec_id"].to_numpy(), a["label"].to_numpy(), _matrix(a["x"], np.int32), _matrix(a["stored"], np.float64))
            queries, d = _matrix(b["x"], np.int32), a["d"][0].as_py()
            pivots = by_length.get(d, np.zeros((1, d + 1)))
            to_query = distances(np.column_stack((queries.astype(np.float64), np.zeros(len(queries)))), pivots)
            opened = [[(x["positive_id"], x["positive_score"]) for x in asks] for asks in b["asks"].to_pylist()]
            windows = [[(-(1 << 62), 1 << 62) if same else (-(-LEAST * s // 100), MOST * s // 100) for _, s in asks] for asks in opened]
            base, q_ids = most + b["squared"].to_numpy(), b["q_id"].to_numpy()
            lists = iter(search(block, q_ids, b["label"].to_numpy(), queries, to_query, base, windows, same, k))
            for q, asks in zip(q_ids, opened, strict=True):
                for (p, p_score), best in zip(asks, lists, strict=False):
                    found += [(int(q), p, p_score, s, i) for s, i in best]
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score", "score", "vec_id"])

    keys = ["d", "vb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "anchor_id long, positive_id long, positive_score long, score long, vec_id long")


def mine(
    vectors: DataFrame, id_name: str = "vec_id", label_name: str = "label", vector_name: str = "embedding", every: int = EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, label: Column | None = None,
    query_bytes: int = QUERY_BYTES, vector_bytes: int = VECTOR_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``label`` may replace the label column."""
    given = F.col(label_name).cast("long") if label is None else label
    picked = vectors.select(F.col(id_name).cast("long").alias("vec_id"), given.alias("label"), whole_numbers(F.col(vector_name)).alias("x"))
    picked = picked.filter("vec_id is not null and label is not null and x is not null").distinct()
    index, most, by_length = pivot_table(picked)
    anchors = index.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("d", "label", "x", "squared")).alias("a")).select("vec_id", "a.*")
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("positive_id"), F.lit(0).cast("long").alias("positive_score")))
    near = _asked(anchors.withColumn("asks", nothing), index, most, by_length, True, positives, query_bytes, vector_bytes)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives)
    asks = near.groupBy("anchor_id").agg(F.collect_set(F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("asks"))
    asking = cut(anchors.join(asks, anchors["vec_id"] == asks["anchor_id"]).drop("anchor_id"), "positives")
    far = _asked(asking, index, most, by_length, False, negatives, query_bytes, vector_bytes)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.col("score").desc(), "vec_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mine(vectors, label=shifted_label(F.col("label").cast("long"), F.col("vec_id")))


#: Brute force over every pair of an anchor and a row.
OP11_SQL = f"""
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label::BIGINT + 1) % {CLASSES} ELSE label::BIGINT END AS label,
             list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
        row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= {POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 100 * score >= {LEAST} * positive_score AND 100 * score <= {MOST} * positive_score)
WHERE rank <= {NEGATIVES}"""
