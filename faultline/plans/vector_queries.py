"""Queries over embeddings: neighbours, votes, retrieval, hybrid scores, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalize
from ..operators import evaluation, scoring, vector_search
from ..operators.cell_index import CellIndex
from ..rules import BETA, BETAS, CATALOGUE_K, NEIGHBOURS, OVERFETCH, THRESHOLD
from ..streaming.index import grow_cells
from .lineage import place

WANTED = "type_7"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a binary label (classes 5 to 9 count as vulnerable), a type, and a stand-in classifier score."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"),
        F.concat(F.lit("type_"), F.col("label").cast("string")).alias("vuln_type"),
        (F.pmod(F.col("vec_id") * 37, F.lit(101)) / 100.0).cast("double").alias("cls_prob"),
    )


def neighbours(spark: SparkSession, sf_dir: str, k: int = NEIGHBOURS) -> DataFrame:
    v = vectors(spark, sf_dir)
    return vector_search.with_metadata(vector_search.top_k(v, v, k), v.select("vec_id", "label", "vuln_type"))


def vec_normalize(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", normalize(F.col("embedding").cast("array<double>")).alias("u"))
    return v.select("vec_id", F.posexplode("u").alias("dim", "value"))


def vec_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return vector_search.top_k(v, v).select("query_id", "rank", "neighbour_id", "score")


def vec_topk_label_fraction(spark, sf_dir):
    return vector_search.label_fraction(neighbours(spark, sf_dir), vectors(spark, sf_dir))


def vec_majority_type(spark, sf_dir):
    return vector_search.majority_type(neighbours(spark, sf_dir), vectors(spark, sf_dir))


def vec_knn_vote(spark, sf_dir):
    """One search feeds both votes: per query the neighbour score, the majority type and its confidence."""
    near = neighbours(spark, sf_dir)
    typed = (F.col("label") == 1) & F.col("vuln_type").isNotNull()
    votes = near.groupBy("query_id", "vuln_type").agg(
        F.count_if(F.col("label") == 1).alias("hits"), F.count(F.lit(1)).alias("n"), F.count_if(typed).alias("votes"), F.min("rank").alias("first")
    )
    best = votes.groupBy("query_id").agg(
        (F.sum("hits") / F.sum("n")).alias("faiss_score"),
        F.max_by("vuln_type", F.when(F.col("votes") > 0, F.struct("votes", -F.col("first")))).alias("t"),
        F.max("votes").alias("top"), F.sum("votes").alias("every"),
    )
    out = vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id")).join(best, "query_id", "left")
    return out.select(
        "query_id", F.coalesce("faiss_score", F.lit(0.5)).alias("faiss_score"),
        F.when(F.col("every") > 0, F.col("t")).otherwise("unknown").alias("vuln_type"),
        evaluation.ratio(F.col("top"), F.col("every")).alias("confidence"),
    )


def vec_retrieve_postfilter(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = vector_search.retrieve_postfilter(v, v, v.select("vec_id", "vuln_type"), F.col("vuln_type") == WANTED, CATALOGUE_K)
    return found.select("query_id", "rank", "neighbour_id", "score")


def vec_retrieve_prefilter(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return vector_search.top_k(v, v.filter(F.col("vuln_type") == WANTED), CATALOGUE_K).select("query_id", "rank", "neighbour_id", "score")


def scored(spark, sf_dir):
    v = vectors(spark, sf_dir)
    share = vector_search.label_fraction(neighbours(spark, sf_dir), v)
    out = v.select(F.col("vec_id").alias("query_id"), "label", "cls_prob").join(share, "query_id")
    return out.withColumn("hybrid_score", scoring.hybrid(F.col("cls_prob"), F.col("faiss_score"), BETA))


def score_hybrid(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("prediction", scoring.predicted(F.col("hybrid_score")))


def score_threshold_split(spark, sf_dir):
    low = F.when(scoring.below_threshold(F.col("hybrid_score")), "SAFE").otherwise("CHECK")
    return scored(spark, sf_dir).groupBy(low.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hybrid_score"), 6).alias("avg_score"))


def score_beta_grid(spark, sf_dir):
    return scoring.beta_grid(scored(spark, sf_dir))


def score_best_beta(spark, sf_dir):
    return scoring.best_beta(scoring.beta_grid(scored(spark, sf_dir)))


def score_accuracy_summary(spark, sf_dir):
    return scoring.accuracy_summary(scored(spark, sf_dir))


def vec_topk_cells(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return vector_search.top_k_cells(v, v, flat_below=0).select("query_id", "rank", "neighbour_id", "score")


def vec_topk_stored(spark, sf_dir):
    """From cells that were built, written and opened again."""
    v, root = vectors(spark, sf_dir), place(spark, "cells")
    CellIndex.build(v, root)
    return CellIndex.open(spark, root).search(v).select("query_id", "rank", "neighbour_id", "score")


def vec_topk_grown(spark, sf_dir):
    """From cells that were built on a third of the vectors and grew by a stream of the others, one micro-batch of which
    arrives twice; cells that became too full were split."""
    v, root, new = vectors(spark, sf_dir), place(spark, "grown-cells"), place(spark, "arrivals")
    CellIndex.build(v.filter("vec_id % 3 = 0"), root, cells=20)
    most = 2 * CellIndex.open(spark, root).cells.sizes.max()
    for part in (1, 2):
        v.filter(F.col("vec_id") % 3 == part).write.mode("append").parquet(new)
        marks = place(spark, "marks")  # a new checkpoint each time: the second stream starts again at batch 0
        stream = "both" if part == 1 else "rest"
        if part == 2:
            again = spark.readStream.schema(v.schema).parquet(new).filter("vec_id % 3 = 1")
            grow_cells(again, root, place(spark, "marks"), "both", int(most)).awaitTermination()
        arriving = spark.readStream.schema(v.schema).parquet(new).filter(F.col("vec_id") % 3 == part)
        grow_cells(arriving, root, marks, stream, int(most)).awaitTermination()
    return CellIndex.open(spark, root).search(v).select("query_id", "rank", "neighbour_id", "score")


def _pairs(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "label", normalize(F.col("embedding").cast("array<double>")).alias("u"), (F.col("vec_id") / 32).cast("long").alias("batch"))
    return evaluation.batch_pairs(v, "batch", "vec_id", "u", "label")


def loss_supcon(spark, sf_dir):
    return evaluation.supervised_contrastive(_pairs(spark, sf_dir)).select("b", F.round("loss", 6).alias("loss"))


def loss_triplet(spark, sf_dir):
    return evaluation.hard_triplet(_pairs(spark, sf_dir)).select("b", F.round("loss", 6).alias("loss"))


_V = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, (label >= 5)::INTEGER AS label, 'type_' || label AS vuln_type,
  ((vec_id * 37) % 101)::DOUBLE / 100.0::DOUBLE AS cls_prob FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v)"""
_PAIR = """SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, c.label, c.vuln_type,
  CASE WHEN c.norm * q.norm > 0 THEN list_inner_product(c.e, q.e) / (c.norm * q.norm) ELSE 0 END AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id"""


def _top(k: int, where: str = "") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbour_id)::INTEGER AS rank FROM ({_PAIR} {where})) WHERE rank <= {k}"


_NEAR = f"WITH {_V}, t AS ({_top(NEIGHBOURS)})"
_SHARE = "f AS (SELECT v.vec_id AS query_id, v.label, v.cls_prob, coalesce(x.s, 0.5)::DOUBLE AS faiss_score FROM v LEFT JOIN (SELECT query_id, avg((label = 1)::INTEGER) AS s FROM t GROUP BY 1) x ON x.query_id = v.vec_id)"
_VOTES = """b AS (SELECT query_id, vuln_type, count(*) AS c, min(rank) AS r FROM t WHERE label = 1 GROUP BY 1, 2),
m AS (SELECT query_id, vuln_type, c / sum(c) OVER (PARTITION BY query_id) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, r) AS o FROM b)"""
_H = f"h AS (SELECT *, {BETA}::DOUBLE * cls_prob + (1::DOUBLE - {BETA}::DOUBLE) * faiss_score AS hybrid_score FROM f)"
_GRID = " UNION ALL ".join(
    f"SELECT {b}::DOUBLE AS beta, avg(((({b}::DOUBLE * cls_prob + (1::DOUBLE - {b}::DOUBLE) * faiss_score) > 0.5::DOUBLE)::INTEGER = label)::INTEGER) AS accuracy FROM f" for b in BETAS
)
_U = f"""WITH {_V}, u AS (SELECT vec_id, label, vec_id // 32 AS b, list_transform(e, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE x END) AS u FROM n),
p AS (SELECT a.b, a.vec_id AS i, list_inner_product(a.u, c.u) AS sim, a.label = c.label AS same FROM u a JOIN u c ON a.b = c.b AND a.vec_id <> c.vec_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        vec_normalize, vec_topk, vec_topk_label_fraction, vec_majority_type, vec_knn_vote, vec_retrieve_postfilter,
        vec_retrieve_prefilter, score_hybrid, score_threshold_split, score_beta_grid, score_best_beta,
        score_accuracy_summary, vec_topk_cells, vec_topk_stored, vec_topk_grown, loss_supcon, loss_triplet,
    )
}
SQL = {
    "vec_normalize": f"WITH {_V} SELECT vec_id, (i - 1)::INTEGER AS dim, CASE WHEN norm > 0 THEN e[i] / norm ELSE e[i] END AS value FROM n, unnest(range(1, len(e) + 1)) AS r(i)",
    "vec_topk": f"{_NEAR} SELECT query_id, rank, neighbour_id, score FROM t",
    "vec_topk_label_fraction": f"{_NEAR}, {_SHARE} SELECT query_id, faiss_score FROM f",
    "vec_majority_type": f"{_NEAR}, {_VOTES} SELECT v.vec_id AS query_id, coalesce(m.vuln_type, 'unknown') AS vuln_type, coalesce(m.confidence, 0)::DOUBLE AS confidence FROM v LEFT JOIN m ON m.query_id = v.vec_id AND o = 1",
    "vec_knn_vote": f"{_NEAR}, {_SHARE}, {_VOTES} SELECT f.query_id, faiss_score, coalesce(m.vuln_type, 'unknown') AS vuln_type, coalesce(m.confidence, 0)::DOUBLE AS confidence FROM f LEFT JOIN m ON m.query_id = f.query_id AND o = 1",
    "vec_retrieve_postfilter": f"WITH {_V}, t AS ({_top(CATALOGUE_K * OVERFETCH)}) SELECT query_id, r AS rank, neighbour_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS r FROM t WHERE vuln_type = '{WANTED}') WHERE r <= {CATALOGUE_K}",
    "vec_retrieve_prefilter": f"WITH {_V}, t AS ({_top(CATALOGUE_K, f'''WHERE c.vuln_type = '{WANTED}' ''')}) SELECT query_id, rank, neighbour_id, score FROM t",
    "score_hybrid": f"{_NEAR}, {_SHARE}, {_H} SELECT query_id, label, cls_prob, faiss_score, hybrid_score, (hybrid_score > 0.5::DOUBLE)::INTEGER AS prediction FROM h",
    "score_threshold_split": f"{_NEAR}, {_SHARE}, {_H} SELECT CASE WHEN hybrid_score < {THRESHOLD}::DOUBLE THEN 'SAFE' ELSE 'CHECK' END AS route, count(*) AS n, round(avg(hybrid_score), 6) AS avg_score FROM h GROUP BY 1",
    "score_beta_grid": f"{_NEAR}, {_SHARE} {_GRID}",
    "score_best_beta": f"{_NEAR}, {_SHARE}, g AS ({_GRID}) SELECT beta, accuracy FROM g ORDER BY accuracy DESC, beta LIMIT 1",
    "score_accuracy_summary": f"{_NEAR}, {_SHARE}, {_H} SELECT avg(((cls_prob > 0.5::DOUBLE)::INTEGER = label)::INTEGER) AS cls_accuracy, avg(((hybrid_score > 0.5::DOUBLE)::INTEGER = label)::INTEGER) AS hybrid_accuracy FROM h",
    "loss_supcon": f"{_U}, r AS (SELECT b, i, ln(sum(exp(sim / 0.07))) - avg(sim / 0.07) FILTER (same) AS l FROM p GROUP BY 1, 2) SELECT b, round(coalesce(avg(l), 0), 6) AS loss FROM r GROUP BY 1",
    "loss_triplet": f"{_U}, r AS (SELECT b, i, max(sqrt(greatest(2 - 2 * sim, 0))) FILTER (same) AS pos, min(sqrt(greatest(2 - 2 * sim, 0))) FILTER (NOT same) AS neg FROM p GROUP BY 1, 2) SELECT b, round(coalesce(avg(greatest(pos - neg + 0.3, 0)) FILTER (pos IS NOT NULL AND neg IS NOT NULL), 0), 6) AS loss FROM r GROUP BY 1",
}
#: The cells lose nothing, so the exact search states them.
SQL |= dict.fromkeys(("vec_topk_cells", "vec_topk_stored", "vec_topk_grown"), SQL["vec_topk"])
