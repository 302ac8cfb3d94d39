"""Reports of scan results as text and JSON, built as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import VERDICTS, verdict_rollup

ICONS = (("CONFIRMED", "[!!]"), ("SUGGESTIVE", "[!]"), ("NEUTRAL", "[?]"), ("SAFE", "[OK]"))
RULE = "=" * 60
REASONING_CHARS, SNIPPET_CHARS = 300, 200


def _percent(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def result_json(results: DataFrame) -> DataFrame:
    """sample_id, json: all fields, with weakness, source and context; review fields only where there is a review."""
    reviewed = F.col("triage_verdict") != ""
    plain = [
        "verdict", "confidence", "cls_prob", "faiss_score", "hybrid_score", "vuln_type", "vuln_type_confidence",
        "exploits_tried", "exploits_confirmed", "evidence_details", "total_time", "cwe_id", "sanitizer_source", "taint_context",
    ]
    review = [F.when(reviewed, F.col(c)).alias(c) for c in ("triage_verdict", "triage_confidence", "triage_reasoning")]
    return results.select("sample_id", F.to_json(F.struct(*plain, *review)).alias("json"))


def result_report(results: DataFrame, snippet: Column | None = None, verbose: bool = False) -> DataFrame:
    """sample_id, report."""
    icon = F.lit("[?]")
    for verdict, sign in ICONS:
        icon = F.when(F.col("verdict") == verdict, F.lit(sign)).otherwise(icon)
    head = [
        F.lit(f"{RULE}\nVULNERABILITY SCAN REPORT\n{RULE}"),
        F.concat(F.lit("\n  Verdict:      "), icon, F.lit(" "), F.col("verdict")),
        F.concat(F.lit("  Confidence:   "), _percent(F.col("confidence"))),
        F.concat(F.lit("  Vuln Type:    "), F.col("vuln_type"), F.lit(" ("), _percent(F.col("vuln_type_confidence")), F.lit(")")),
        F.format_string("  Total Time:   %.2fs", "total_time"),
        F.format_string("\n  Detection Scores:\n    Classifier:   %.4f\n    FAISS:        %.4f\n    Hybrid:       %.4f", "cls_prob", "faiss_score", "hybrid_score"),
    ]
    tried = F.format_string("\n  Exploit Verification:\n    Tried:      %d\n    Confirmed:  %d", "exploits_tried", "exploits_confirmed")
    details = F.array_join(
        F.transform("evidence_details", lambda d, i: F.format_string(
            "\n    --- Exploit #%d: %s ---\n    Evidence:   %s\n    Reason:     %s\n    Exit code:  %d\n    Compiled:   %s\n    Time:       %.2fs",
            i + 1, d["exploit_id"], d["evidence_level"], d["reason"], d["exit_code"], F.initcap(d["compiled"].cast("string")), d["execution_time"],
        )), "\n",
    )
    why = F.col("triage_reasoning")
    reasoning = F.concat(F.lit("    Reasoning:  "), F.substring(why, 1, REASONING_CHARS), F.when(F.length(why) > REASONING_CHARS, "...").otherwise(""))
    reviewed = F.col("triage_verdict") != ""
    parts = [
        *head,
        F.when(F.col("exploits_tried") > 0, tried),
        F.when((F.col("exploits_tried") > 0) & (F.size("evidence_details") > 0) & F.lit(verbose), details),
        F.when(reviewed, F.concat(F.format_string("\n  Triage Head (LLM):\n    Verdict:    %s\n    Confidence: ", "triage_verdict"), _percent(F.col("triage_confidence")))),
        F.when(reviewed & F.lit(verbose) & (why != ""), reasoning),
    ]
    if snippet is not None:
        parts.append(F.when(snippet != "", F.concat(F.lit(f"\n  Code (first {SNIPPET_CHARS} chars):\n    "), F.substring(snippet, 1, SNIPPET_CHARS))))
    return results.select("sample_id", F.concat_ws("\n", *parts, F.lit("\n" + RULE)).alias("report"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row, one text: counts and shares of verdicts and the average time."""
    r = verdict_rollup(results)
    lines = [F.format_string("Batch Summary (%d samples):", "total")]
    for v in VERDICTS:
        label = f"  {v}:".ljust(14)
        lines.append(F.concat(F.lit(label), F.format_string("%d (", v.lower()), _percent(F.col(f"{v.lower()}_share"), 1), F.lit(")")))
    lines.append(F.format_string("  Avg time:   %.2fs", "avg_time"))
    return r.select(F.when(F.col("total") == 0, "No results.").otherwise(F.concat_ws("\n", *lines)).alias("summary"))
