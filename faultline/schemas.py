"""Explicit schemas of the engine's tables; none is ever inferred."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql.types import StructType

_DDL = {
    "code_samples": "idx long, func string, target int, project string, commit_id string",
    "vector_index": "idx long, label int, vuln_type string, func_snippet string, embedding array<float>",
    "template_catalogue": (
        "exploit_id string, vuln_type string, language string, payload_template string, harness_template string, "
        "expected_behavior string, source_cve string, tags array<string>, compilation_cmd string, timeout_sec int, "
        "expected_signals array<string>, description string"
    ),
    "predictions": "idx long, cls_prob double, faiss_score double, hybrid_score double, prediction int, label int",
    "exec_log": (
        "run_id long, sample_id long, ord int, exit_code int, stdout string, stderr string, timed_out boolean, "
        "expected_signals array<string>, compiled boolean, execution_time double, sanitizer_profile string, fuzz_mode boolean"
    ),
    "evidence": (
        "sample_id long, ord int, exploit_id string, evidence_level string, reason string, exit_code int, "
        "execution_time double, compiled boolean, confidence double, cwe_id string, sanitizer_source string, "
        "sanitizer_profile string, fuzz_mode boolean"
    ),
    "triage": "sample_id long, verdict string, confidence double, reasoning string",
    "call_edges": "sample_id long, caller string, callee string, line int",
    "functions": "sample_id long, name string, start_line int, end_line int",
    "taint_paths": (
        "sample_id long, source_func string, source_line int, sink_func string, sink_line int, sink_category string, "
        "intermediates array<string>"
    ),
    "scan_results": (
        "sample_id long, verdict string, confidence double, cls_prob double, faiss_score double, hybrid_score double, "
        "vuln_type string, vuln_type_confidence double, exploits_tried int, exploits_confirmed int, "
        "evidence_details array<struct<exploit_id:string,evidence_level:string,reason:string,exit_code:int,"
        "execution_time:double,compiled:boolean,confidence:double,cwe_id:string,sanitizer_source:string,"
        "sanitizer_profile:string,fuzz_mode:boolean>>, total_time double, cwe_id string, sanitizer_source string, "
        "taint_context string, triage_verdict string, triage_confidence double, triage_reasoning string"
    ),
}


class _Schemas(Mapping):
    """Parsed when first asked for: parsing needs a session, importing must not."""

    def __getitem__(self, name: str) -> StructType:
        return StructType.fromDDL(_DDL[name])

    def __iter__(self) -> Iterator[str]:
        return iter(_DDL)

    def __len__(self) -> int:
        return len(_DDL)


SCHEMAS = _Schemas()
