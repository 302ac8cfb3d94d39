"""Command line: scan tables of samples, evaluate predictions, build an index.

    python -m faultline.cli scan --samples S --index I --logs L --reviews R --out O [--mode full] [--report]
    python -m faultline.cli scan --jsonl J --scores P --limit 100 --max-exploits 3 --out O
    python -m faultline.cli evaluate --predictions P --out O
    python -m faultline.cli index --vectors V --path I [--append]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import rules
from .api import MODES, ScanConfig, Scanner
from .operators import evaluation, report
from .sources import readers, writers


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="faultline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="one result per sample")
    given = scan.add_mutually_exclusive_group(required=True)
    given.add_argument("--samples", help="parquet: sample_id, code, cls_prob, embedding")
    given.add_argument("--jsonl", help="JSON lines: func or code, target or label; the line's number is the sample_id")
    given.add_argument("--file", help="source files, each one sample")
    given.add_argument("--code", help="one sample as text, sample_id 0")
    scan.add_argument("--scores", help="parquet: sample_id, cls_prob, embedding, for samples that bring none; without, each sample is checked")
    scan.add_argument("--limit", type=int, default=0, help="first lines of --jsonl, blank ones too")
    scan.add_argument("--max-exploits", type=int, default=rules.MAX_HARNESSES, help="runs of a sample that count")
    scan.add_argument("--index", help="an index of vec_id, embedding, label, vuln_type")
    scan.add_argument("--logs", help="parquet: the exec_log table")
    scan.add_argument("--reviews", help="parquet: sample_id, response")
    scan.add_argument("--out", required=True)
    scan.add_argument("--mode", choices=MODES, default="full")
    scan.add_argument("--beta", type=float, default=rules.BETA)
    scan.add_argument("--neighbours", type=int, default=rules.NEIGHBOURS)
    scan.add_argument("--threshold", type=float, default=rules.THRESHOLD)
    scan.add_argument("--no-early-stop", dest="early_stop", action="store_false")
    scan.add_argument("--no-taint", dest="taint", action="store_false")
    scan.add_argument("--report", action="store_true", help="write text reports and the batch summary as well")
    scan.add_argument("--verbose", action="store_true")
    evaluate = commands.add_parser("evaluate", help="rates, AUC and times of a table of predictions")
    evaluate.add_argument("--predictions", required=True, help="parquet: prediction, label and optionally score, seconds, before, tried, confirmed")
    evaluate.add_argument("--out", required=True)
    evaluate.add_argument("--mode", choices=("full", "detection-only", "sandbox-only"), default="full", help="named in the result")
    index = commands.add_parser("index", help="write or grow an index")
    index.add_argument("--vectors", required=True)
    index.add_argument("--path", required=True)
    index.add_argument("--append", action="store_true")
    return parser.parse_args(argv)


def samples(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What to scan, with the scores that go with it."""
    if a.samples:
        found = spark.read.parquet(a.samples)
    elif a.jsonl:
        found = readers.batch_jsonl(spark, a.jsonl, a.limit).withColumnRenamed("line_no", "sample_id")
    elif a.file:
        found = readers.source_file(spark, a.file)
    else:
        found = readers.inline(spark, a.code)
    if not a.scores:
        return found
    scores = spark.read.parquet(a.scores)
    return found.join(scores.select("sample_id", *[c for c in ("cls_prob", "embedding") if c in scores.columns]), "sample_id", "left").fillna(1.0, ["cls_prob"])


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("faultline").getOrCreate()

    def table(path: str | None):
        return spark.read.parquet(path) if path else None

    if a.command == "scan":
        config = ScanConfig(beta=a.beta, neighbours=a.neighbours, threshold=a.threshold, mode=a.mode, early_stop=a.early_stop, taint=a.taint, max_exploits=a.max_exploits)
        given = samples(spark, a)
        index = readers.vector_index(spark, a.index) if a.index else None
        results = Scanner(index, config).scan_batch(given, table(a.logs), table(a.reviews))
        results.write.mode("overwrite").parquet(f"{a.out}/results")
        results = spark.read.parquet(f"{a.out}/results")  # reports come from what was written, nothing is scanned twice
        writers.text(report.result_json(results), "json", f"{a.out}/json")
        if "label" in given.columns:
            labelled = results.join(given.select("sample_id", "label"), "sample_id")
            writers.results_json(labelled.select(F.col("sample_id").alias("index"), "label", F.struct(*results.columns).alias("result")), f"{a.out}/batch")
        if a.report:
            writers.text(report.result_report(results, verbose=a.verbose), "report", f"{a.out}/reports")
            writers.text(report.batch_summary(results), "summary", f"{a.out}/summary")
    elif a.command == "evaluate":
        rows = table(a.predictions)
        has = {c: c for c in ("before", "tried", "confirmed", "seconds") if c in rows.columns}
        parts = [evaluation.summary(rows, a.mode, **has)]
        if "score" in rows.columns:
            parts.append(evaluation.roc_auc(rows))
        metrics = {k: v for part in parts for k, v in part.first().asDict().items()}  # one row of numbers each
        writers.metrics_json(spark.createDataFrame([Row(**metrics)]), a.out)
    else:
        writers.index(table(a.vectors), a.path, "append" if a.append else "overwrite")


if __name__ == "__main__":
    main()
