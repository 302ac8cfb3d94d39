"""The scanner: from tables of scores, logs and reviews to one result per sample.

Language models and execution of native code happen elsewhere; their outputs come in as tables. Scores come in as columns, or
from a function of the samples that the scanner is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .operators import evidence, scoring, taint, triage, vector_search, verdict
from .plans.lineage import cut

MODES = ("full", "sandbox-only", "triage-only", "dry-run")


@dataclass(frozen=True)
class ScanConfig:
    """Plan-time constants of a scan."""

    beta: float = rules.BETA
    neighbours: int = rules.NEIGHBOURS
    threshold: float = rules.THRESHOLD
    mode: str = "full"
    max_exploits: int = rules.MAX_HARNESSES
    early_stop: bool = True
    taint: bool = True
    snippet_chars: int = 200

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}, not {self.mode!r}")


class Scanner:
    """Samples are ``sample_id, code, cls_prob, embedding``; the index ``vec_id, embedding, label, vuln_type``.

    ``score_fn`` takes samples without scores and returns them with ``cls_prob`` and, for an index, ``embedding``; it runs
    once a scan. Without it, samples that bring no ``cls_prob`` count as 1: each of them is checked.
    """

    def __init__(self, index: DataFrame | None = None, config: ScanConfig | None = None, score_fn: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.index, self.config, self.score_fn = index, config or ScanConfig(), score_fn

    def scored(self, samples: DataFrame) -> DataFrame:
        if "cls_prob" in samples.columns:
            return samples
        if self.score_fn is None:
            return samples.withColumn("cls_prob", F.lit(1.0))
        return cut(self.score_fn(samples), "scored")

    def detect(self, samples: DataFrame) -> DataFrame:
        """Adds faiss_score, hybrid_score, prediction, vuln_type and its confidence. One search feeds score and type."""
        c, samples = self.config, self.scored(samples)
        if self.index is None or "embedding" not in samples.columns:
            out = samples.withColumns({"faiss_score": F.lit(None).cast("double"), "vuln_type": F.lit("unknown"), "vuln_type_confidence": F.lit(0.0)})
        else:
            queries = samples.select(F.col("sample_id").alias("vec_id"), "embedding")
            near = vector_search.with_metadata(vector_search.top_k(queries, self.index, c.neighbours, skip_self=False), self.index.select("vec_id", "label", "vuln_type"))
            share = vector_search.label_fraction(near, queries).withColumnRenamed("query_id", "sample_id")
            kind = vector_search.majority_type(near, queries).select(F.col("query_id").alias("sample_id"), "vuln_type", F.col("confidence").alias("vuln_type_confidence"))
            out = samples.join(share, "sample_id").join(kind, "sample_id")
        hybrid = scoring.hybrid(F.col("cls_prob"), F.col("faiss_score"), c.beta)
        out = out.withColumn("hybrid_score", hybrid).withColumn("faiss_score", F.coalesce("faiss_score", F.lit(0.5)))
        return out.withColumn("prediction", scoring.predicted(F.col("hybrid_score")))

    def scan_batch(self, samples: DataFrame, logs: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
        """One row per sample with the fields of ``schemas.SCHEMAS["scan_results"]``.

        ``logs``: the exec_log table; ``reviews``: ``sample_id, response``. Either may be absent, as may a sample in it.
        """
        c, spark, samples = self.config, samples.sparkSession, self.scored(samples)
        found = self.detect(samples)
        if logs is None or c.mode in ("triage-only", "dry-run"):
            proof = spark.createDataFrame([], "sample_id long, ord int, evidence_level string, reason string, exit_code int, execution_time double, compiled boolean, confidence double, cwe_id string, sanitizer_source string, sanitizer_profile string, fuzz_mode boolean")
        else:
            tried = evidence.cap(logs, "sample_id", [F.col("ord")], c.max_exploits)  # the first runs of a sample; the others do not count
            classified = evidence.classify(tried).withColumnRenamed("level", "evidence_level").drop("stdout", "stderr", "asan_report")
            proof = cut(classified, "evidence")  # read four times below; logs are matched once
            if c.early_stop:
                proof = evidence.until_first(proof, "sample_id", "ord", F.col("evidence_level") == "CONFIRMED")
        if reviews is None or c.mode in ("sandbox-only", "dry-run"):
            said = spark.createDataFrame([], "sample_id long, verdict string, confidence double, reasoning string")
        else:
            said = triage.parse_triage(reviews).select("sample_id", "verdict", "confidence", "reasoning")
        rolled = evidence.rollup(proof)
        fused = verdict.fuse(found.select("sample_id", "hybrid_score"), rolled, said, c.threshold).drop("hybrid_score")
        detail = proof.groupBy("sample_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(
                F.coalesce(F.col("ord").cast("string"), F.lit("")).alias("exploit_id"), "evidence_level", "reason", "exit_code",
                "execution_time", "compiled", "confidence", "cwe_id", "sanitizer_source", "sanitizer_profile", "fuzz_mode",
            ).alias("d")))), lambda x: x["d"]).alias("evidence_details"),
            F.sum("execution_time").alias("total_time"),
        )
        out = found.join(fused, "sample_id").join(detail, "sample_id", "left").join(rolled.select("sample_id", "cwe_id", "sanitizer_source"), "sample_id", "left")
        out = out.join(said.select("sample_id", F.col("verdict").alias("triage_verdict"), F.col("confidence").alias("triage_confidence"), F.col("reasoning").alias("triage_reasoning")), "sample_id", "left")
        if c.taint:
            code = samples.select("sample_id", "code")
            out = out.join(taint.context(taint.paths(code), taint.call_edges(code, taint.functions_of(code)), code), "sample_id", "left")
        else:
            out = out.withColumn("taint_context", F.lit(""))
        checked = F.col("hybrid_score") >= c.threshold  # below it nothing else was asked
        texts = {x: F.when(checked, F.coalesce(x, F.lit(""))).otherwise("") for x in ("cwe_id", "sanitizer_source", "triage_verdict", "triage_reasoning")}
        none = F.array().cast(detail.schema["evidence_details"].dataType)
        return out.withColumns(texts | {
            "taint_context": F.coalesce("taint_context", F.lit("")), "triage_confidence": F.when(checked, F.coalesce("triage_confidence", F.lit(0.0))).otherwise(0.0),
            "evidence_details": F.when(checked, F.coalesce("evidence_details", none)).otherwise(none), "total_time": F.coalesce("total_time", F.lit(0.0)),
        }).select(
            "sample_id", "verdict", "confidence", "cls_prob", "faiss_score", "hybrid_score", "vuln_type", "vuln_type_confidence",
            F.col("exploits_tried").cast("int").alias("exploits_tried"), F.col("exploits_confirmed").cast("int").alias("exploits_confirmed"),
            "evidence_details", "total_time", "cwe_id", "sanitizer_source", "taint_context", "triage_verdict", "triage_confidence", "triage_reasoning",
        )
