"""Queries over logs, programs and reviews made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import evidence, taint, triage, verdict
from ..sources import readers
from . import fixtures as fx
from .lineage import cut


# ---- evidence -----------------------------------------------------------------------------------------------


def evidence_matches(spark, sf_dir):
    text = evidence.combined(F.col("stdout"), F.col("stderr"))
    return fx.logs(spark, sf_dir).select("run_id", F.posexplode(evidence.direct_matches(text)).alias("pos", "m")).select("run_id", "pos", "m.category", "m.pattern")


def evidence_level(spark, sf_dir):
    return evidence.classify(fx.logs(spark, sf_dir)).select("run_id", "level", "reason", F.array_join("matched_patterns", " && ").alias("patterns"))


def evidence_confidence(spark, sf_dir):
    return evidence.classify(fx.logs(spark, sf_dir)).select("run_id", F.round("confidence", 3).alias("confidence"), "sanitizer_source", "valgrind_errors")


def evidence_cwe(spark, sf_dir):
    return evidence.classify(fx.logs(spark, sf_dir)).select("run_id", "cwe_id")


def evidence_asan(spark, sf_dir):
    return evidence.classify(fx.logs(spark, sf_dir)).filter("asan_report is not null").select(
        "run_id", "asan_report.error_type", "asan_report.access_type", "asan_report.access_size", "asan_report.address",
        "asan_report.description", F.array_join("asan_report.stack_frames", "; ").alias("frames"),
    )


def _evidence(spark, sf_dir):
    return evidence.classify(fx.logs(spark, sf_dir)).withColumnRenamed("level", "evidence_level")


def evidence_rollup(spark, sf_dir):
    return evidence.rollup(_evidence(spark, sf_dir))


def evidence_stop_runs(spark, sf_dir):
    classified = cut(_evidence(spark, sf_dir).select("run_id", "sample_id", "ord", "evidence_level"), "levels")  # read twice
    return evidence.until_first(classified, "sample_id", "ord", F.col("evidence_level") == "CONFIRMED").select("run_id", "sample_id", "ord", "evidence_level")


def evidence_profiles(spark, sf_dir):
    return evidence.profiles(fx.kinds(spark, sf_dir))


def rule_expectations(spark, sf_dir):
    found = evidence.expectations(fx.kinds(spark, sf_dir))
    return found.select("sample_id", "vuln_type", "sanitizers", F.array_join("expected_signals", ", ").alias("signals"))


# ---- source to sink -----------------------------------------------------------------------------------------


def taint_sources(spark, sf_dir):
    return taint.source_hits(taint.lines_of(fx.codes(spark, sf_dir))).select("sample_id", "line", "source_func")


def taint_sinks(spark, sf_dir):
    return taint.sink_hits(taint.lines_of(fx.codes(spark, sf_dir))).select("sample_id", "line", "sink_func", "sink_category")


def taint_paths(spark, sf_dir):
    return taint.paths(fx.codes(spark, sf_dir))


def taint_functions(spark, sf_dir):
    return taint.functions_of(fx.codes(spark, sf_dir))


def taint_calls(spark, sf_dir):
    codes = fx.codes(spark, sf_dir)
    return taint.call_edges(codes, taint.functions_of(codes))


def taint_callers(spark, sf_dir):
    codes = fx.codes(spark, sf_dir)
    edges = taint.call_edges(codes, taint.functions_of(codes))
    return taint.callers(edges, edges.select("sample_id", F.col("callee").alias("func")).distinct())


def taint_context(spark, sf_dir):
    codes = fx.codes(spark, sf_dir)
    return taint.context(taint.paths(codes), taint.call_edges(codes, taint.functions_of(codes)), codes)


def cpg_sections(spark, sf_dir):
    rows = readers.graph_tool_rows(fx.graph_tool(spark, sf_dir))
    return rows.select("sample_id", "line_no", "section", F.array_join("parts", "|").alias("fields"))


def cpg_paths(spark, sf_dir):
    return readers.graph_tool_paths(readers.graph_tool_rows(fx.graph_tool(spark, sf_dir)))


# ---- reviews and verdicts -----------------------------------------------------------------------------------


def triage_parse(spark, sf_dir):
    return triage.parse_triage(fx.reviews(spark, sf_dir)).select("sample_id", "verdict", "confidence", "reasoning")


def _fused(spark, sf_dir):
    reviews = triage.parse_triage(fx.reviews(spark, sf_dir))
    return verdict.fuse(fx.predictions(spark, sf_dir), evidence.rollup(_evidence(spark, sf_dir)), reviews)


def verdict_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).select("sample_id", "verdict", "exploits_tried", "exploits_confirmed")


def verdict_confidence(spark, sf_dir):
    return _fused(spark, sf_dir).select("sample_id", F.round("confidence", 6).alias("confidence"))


# ---- the same in SQL ----------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LOGS = f"l AS (SELECT *, coalesce(stdout, '') || chr(10) || coalesce(stderr, '') AS t FROM {fx.LOGS_SQL})"
def _held(patterns, text: str = "t") -> str:
    """A list of the (category, pattern) that ``text`` matches, in their order."""
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {_q(p)}) THEN {{'category': '{c}', 'pattern': {_q(p)}}} END" for c, p in patterns)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_DIRECT = _held([(c, p) for c, ps in rules.DIRECT for p in ps])
_VALGRIND = _held([("", p) for p in rules.VALGRIND])
_HINTS = _held([("", p) for p in rules.SUGGESTIVE])
_SIGNAL = "CASE exit_code " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in rules.SIGNALS) + " END"
_CWE = "CASE " + " ".join(f"WHEN contains(t, {_q(k)}) THEN '{c}'" for k, c in rules.CWE) + " ELSE '' END"
_LADDER = f"""WITH {_LOGS},
m AS (SELECT l.*, {_DIRECT} AS held, list_transform({_VALGRIND}, lambda x: x.pattern) AS vals, list_transform({_HINTS}, lambda x: x.pattern) AS hints FROM l),
x AS (SELECT *, {_SIGNAL} AS sig, list_transform(held, lambda x: x.category) AS cats, list_transform(held, lambda x: x.pattern) AS pats,
  coalesce(try_cast(regexp_extract(t, 'ERROR SUMMARY: (\\d+) errors', 1) AS INTEGER), 0) AS errs,
  list_filter(coalesce(expected_signals, []::VARCHAR[]), lambda s: contains(lower(t), lower(s)))[1] AS want FROM m),
s AS (SELECT *, CASE WHEN len(pats) > 0 THEN 1 WHEN sig IS NOT NULL THEN 2 WHEN want IS NOT NULL THEN 3
  WHEN len(list_filter(vals, lambda p: contains(p, 'Invalid'))) > 0 THEN 4
  WHEN len(vals) > 0 AND (errs > 0 OR len(list_filter(vals, lambda p: contains(p, 'definitely lost'))) > 0) THEN 5
  WHEN exit_code <> 0 AND NOT coalesce(timed_out, false) AND len(hints) > 0 THEN 6 WHEN exit_code <> 0 AND NOT coalesce(timed_out, false) THEN 7
  WHEN coalesce(timed_out, false) THEN 8 WHEN len(hints) = 0 THEN 9 ELSE 10 END AS step FROM x),
e AS (SELECT run_id, sample_id, ord, errs AS valgrind_errors,
  CASE WHEN step <= 4 THEN 'CONFIRMED' WHEN step <= 7 THEN 'SUGGESTIVE' WHEN step = 9 THEN 'SAFE' ELSE 'NEUTRAL' END AS level,
  CASE step WHEN 1 THEN 'Direct exploitation evidence: ' || array_to_string(list_transform(range(1, least(len(pats), 5) + 1), lambda i: cats[i] || ': ' || pats[i]), '; ')
    WHEN 2 THEN format('Process killed by {{}} (exit code {{}})', sig, exit_code) WHEN 3 THEN 'Expected signal found: ' || want
    WHEN 4 THEN 'Valgrind detected invalid memory access' WHEN 5 THEN format('Valgrind: {{}} errors, memory issues detected', errs)
    WHEN 6 THEN format('Non-zero exit ({{}}) with suspicious output: ', exit_code) || array_to_string(hints[1:3], '; ')
    WHEN 7 THEN format('Non-zero exit code: {{}}', exit_code) WHEN 8 THEN 'Process timed out — no conclusive evidence'
    WHEN 9 THEN 'Clean exit with no sanitizer reports' ELSE 'Inconclusive — no clear signal' END AS reason,
  CASE step WHEN 1 THEN pats WHEN 2 THEN [sig] WHEN 3 THEN [want] WHEN 4 THEN vals WHEN 5 THEN vals WHEN 6 THEN hints ELSE [] END AS matched,
  CASE step WHEN 1 THEN least(least(least(
      CASE WHEN list_contains(cats, 'ASAN') THEN 0.95 WHEN list_contains(cats, 'MSAN') THEN 0.93 WHEN list_contains(cats, 'TSAN') THEN 0.91 WHEN list_contains(cats, 'UBSAN') THEN 0.90 ELSE 0.85 END::DOUBLE
      + CASE WHEN len(list_distinct(cats)) > 1 THEN 0.05 ELSE 0 END, 1) + CASE WHEN len(vals) > 0 THEN 0.03 ELSE 0 END, 1) + CASE WHEN sig IS NOT NULL THEN 0.02 ELSE 0 END, 1)
    WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.85 WHEN 5 THEN 0.6 WHEN 6 THEN 0.5 WHEN 7 THEN 0.3 WHEN 9 THEN 1.0 ELSE 0 END::DOUBLE AS conf,
  CASE step WHEN 1 THEN CASE WHEN list_contains(cats, 'ASAN') THEN 'asan' WHEN list_contains(cats, 'MSAN') THEN 'msan' WHEN list_contains(cats, 'TSAN') THEN 'tsan' WHEN list_contains(cats, 'UBSAN') THEN 'ubsan' ELSE 'crash' END
    WHEN 4 THEN 'valgrind' WHEN 5 THEN 'valgrind' ELSE '' END AS sanitizer_source,
  CASE step WHEN 1 THEN {_CWE} WHEN 5 THEN 'CWE-401' ELSE '' END AS cwe_id, list_contains(cats, 'ASAN') AS asan, t
  FROM s),
u AS (SELECT sample_id, count(*) FILTER (level = 'CONFIRMED') AS confirmed, count(*) FILTER (level = 'SUGGESTIVE') AS suggestive, count(*) AS total,
  max(conf) FILTER (level = 'CONFIRMED') AS max_confidence, coalesce(arg_min(cwe_id, ord) FILTER (level = 'CONFIRMED' AND cwe_id <> ''), '') AS cwe_id,
  coalesce(arg_min(sanitizer_source, ord) FILTER (level = 'CONFIRMED' AND sanitizer_source <> ''), '') AS sanitizer_source FROM e GROUP BY 1)"""
_ACCESS = "(READ|WRITE) of size (\\d+) at (0x[0-9a-fA-F]+)"
_LINES = f"c AS (SELECT sample_id, code, string_split(code, chr(10)) AS ls FROM {fx.CODES_SQL}), n AS (SELECT sample_id, line, ls[line] AS text FROM c, unnest(range(1, len(ls) + 1)) AS x(line))"


def _named(columns: str, rows: list[tuple], pattern: str) -> str:
    """One struct for each row of constants whose pattern a line matches."""
    names = columns.split(", ")
    cases = ", ".join(
        f"CASE WHEN regexp_matches(text, '{pattern.format(r[0])}') THEN {{" + ", ".join(f"'{n}': {x!r}" for n, x in zip(names, r, strict=True)) + "} END" for r in rows
    )
    return f"unnest(list_filter([{cases}], lambda x: x IS NOT NULL))"


_SRC = _named("name, o", [(s, i) for i, s in enumerate(rules.SOURCES)], r"\b{}\b")
_SNK = _named("name, cat, o", [(s, c, i) for i, (s, c) in enumerate((s, c) for c, ns in rules.SINKS for s in ns)], r"\b{}\s*\(")
_HITS = f"WITH {_LINES}, a AS (SELECT sample_id, line, h.name, h.o FROM (SELECT sample_id, line, {_SRC} AS h FROM n)), b AS (SELECT sample_id, line, h.name, h.cat, h.o FROM (SELECT sample_id, line, {_SNK} AS h FROM n))"
PATHS_SQL = f"""{_HITS}, p AS (SELECT a.sample_id, a.name AS source_func, a.line AS source_line, b.name AS sink_func, b.line AS sink_line, b.cat AS sink_category, a.o AS ao, b.o AS bo FROM a JOIN b USING (sample_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, source_func, sink_func, sink_line ORDER BY source_line, ao, bo) AS r FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY source_line, ao, bo, sink_line) AS path_no FROM k WHERE r = 1)"""
_HEAD = r"(?:(?:static|void|int|char|long|unsigned|short|float|double|size_t|ssize_t)\s*\*?\s+)+(\w+)\s*\([^)]*\)\s*\{"
_CONTROL = "('if', 'for', 'while', 'switch', 'return', 'sizeof')"
#: A definition's head begins on the first line from which the code matches it at once; its name is the match's.
_FUNCS = f"""fh AS (SELECT sample_id, line, array_to_string(ls[line:], chr(10)) AS rest, ls FROM c, unnest(range(1, len(ls) + 1)) AS x(line)),
fs AS (SELECT sample_id, line AS start_line, regexp_extract(rest, '^{_HEAD}', 1) AS name, ls FROM fh WHERE regexp_matches(rest, '^{_HEAD}')),
fd AS (SELECT sample_id, name, start_line, l, sum(length(ls[l]) - length(replace(ls[l], '{{', '')) - length(ls[l]) + length(replace(ls[l], '}}', ''))) OVER (PARTITION BY sample_id, name, start_line ORDER BY l) AS depth FROM fs, unnest(range(start_line, len(ls) + 1)) AS x(l)),
fn AS (SELECT sample_id, name, start_line, coalesce(min(l) FILTER (l > start_line AND depth <= 0), start_line) AS end_line FROM fd WHERE name NOT IN {_CONTROL} GROUP BY 1, 2, 3)"""
_CALLS = f"""{_FUNCS}, cs AS (SELECT sample_id, line, unnest(regexp_extract_all(text, '\\b(\\w+)\\s*\\(', 1)) AS callee FROM n),
ce AS (SELECT DISTINCT sample_id, name AS caller, callee, line FROM cs JOIN fn USING (sample_id) WHERE line BETWEEN start_line AND end_line AND callee NOT IN {_CONTROL} AND callee <> name)"""
_REVIEW = f"""rv AS (SELECT sample_id, response, CASE WHEN json_valid(regexp_replace(regexp_replace(trim(response), '^```[^\\n]*\\n', ''), '\\s*```\\s*$', '')) THEN regexp_replace(regexp_replace(trim(response), '^```[^\\n]*\\n', ''), '\\s*```\\s*$', '')
  WHEN json_valid(regexp_extract(response, '(?s)\\{{.*\\}}')) THEN regexp_extract(response, '(?s)\\{{.*\\}}') END AS j FROM (SELECT sample_id, coalesce(response, '') AS response FROM {fx.REVIEWS_SQL})),
tv AS (SELECT sample_id, CASE WHEN json_extract_string(j, '$.verdict') IN ('true_positive', 'false_positive', 'uncertain') THEN json_extract_string(j, '$.verdict') ELSE 'uncertain' END AS verdict,
  CASE WHEN j IS NULL THEN 0 ELSE greatest(0, least(1, coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5))) END::DOUBLE AS confidence,
  CASE WHEN j IS NULL THEN 'Failed to parse LLM response: ' || response[1:500] ELSE coalesce(json_extract_string(j, '$.reasoning'), 'No reasoning provided') END AS reasoning FROM rv)"""
_FUSE = f"""{_LADDER}, {_REVIEW}, pr AS (SELECT * FROM {fx.PREDICTIONS_SQL}),
j AS (SELECT pr.sample_id, hybrid_score AS h, CASE WHEN hybrid_score >= 0.5 THEN coalesce(total, 0) ELSE 0 END AS total, CASE WHEN hybrid_score >= 0.5 THEN coalesce(confirmed, 0) ELSE 0 END AS c,
  coalesce(suggestive, 0) AS s, max_confidence AS mc, tv.verdict AS v, tv.confidence AS tc FROM pr LEFT JOIN u USING (sample_id) LEFT JOIN tv USING (sample_id)),
z AS (SELECT *, CASE WHEN h < 0.5 THEN 'SAFE' WHEN c > 0 THEN 'CONFIRMED' WHEN s > 0 AND v = 'false_positive' THEN 'NEUTRAL' WHEN s > 0 THEN 'SUGGESTIVE' WHEN v = 'true_positive' THEN 'SUGGESTIVE'
  WHEN v = 'false_positive' THEN 'SAFE' WHEN total = 0 AND h > 0.7::DOUBLE THEN 'SUGGESTIVE' ELSE 'NEUTRAL' END AS verdict,
  least(0.99, 0.5 * h + 0.5 * mc) AS b FROM j)"""

QUERIES = {
    f.__name__: f
    for f in (
        evidence_matches, evidence_level, evidence_confidence, evidence_cwe, evidence_asan, evidence_rollup,
        evidence_stop_runs, evidence_profiles, rule_expectations, taint_sources, taint_sinks, taint_paths,
        taint_functions, taint_calls, taint_callers, taint_context, cpg_sections, cpg_paths, triage_parse, verdict_fuse,
        verdict_confidence,
    )
}
SQL = {
    "evidence_matches": f"{_LADDER} SELECT run_id, (i - 1)::INTEGER AS pos, held[i].category AS category, held[i].pattern AS pattern FROM m, unnest(range(1, len(held) + 1)) AS r(i)",
    "evidence_level": f"{_LADDER} SELECT run_id, level, reason, array_to_string(matched, ' && ') AS patterns FROM e",
    "evidence_confidence": f"{_LADDER} SELECT run_id, round(conf, 3) AS confidence, sanitizer_source, valgrind_errors FROM e",
    "evidence_cwe": f"{_LADDER} SELECT run_id, cwe_id FROM e",
    "evidence_asan": f"{_LADDER} SELECT run_id, regexp_extract(t, 'ERROR: AddressSanitizer: (\\S+)', 1) AS error_type, regexp_extract(t, '{_ACCESS}', 1) AS access_type, coalesce(try_cast(regexp_extract(t, '{_ACCESS}', 2) AS INTEGER), 0) AS access_size, regexp_extract(t, '{_ACCESS}', 3) AS address, regexp_extract(t, '(Address 0x[0-9a-fA-F]+ is .+)', 1) AS description, array_to_string(list_transform(regexp_extract_all(t, '#\\d+ 0x[0-9a-fA-F]+ in \\S+ .+'), lambda f: regexp_replace(f, '^#(\\d+) 0x[0-9a-fA-F]+ in (\\S+) (.+)$', '#\\1 \\2 (\\3)')), '; ') AS frames FROM e WHERE asan",
    "evidence_rollup": f"{_LADDER} SELECT * FROM u",
    "evidence_stop_runs": f"{_LADDER} SELECT run_id, sample_id, ord, level AS evidence_level FROM (SELECT *, coalesce(sum((level = 'CONFIRMED')::INTEGER) OVER (PARTITION BY sample_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e) WHERE b = 0",
    "evidence_profiles": f"WITH k AS (SELECT * FROM {fx.KINDS_SQL}), p(profile, kind) AS (VALUES {', '.join(f"""('{n}', '{k}')""" for n, ks in rules.PROFILES for k in ks)}) SELECT sample_id, vuln_type, coalesce(profile, 'asan_ubsan') AS profile FROM k LEFT JOIN p ON kind = vuln_type",
    "rule_expectations": f"SELECT sample_id, k.vuln_type, coalesce(sanitizers, '') AS sanitizers, coalesce(signals, '') AS signals FROM {fx.KINDS_SQL} k LEFT JOIN (VALUES " + ", ".join(f"({_q(k)}, {_q(s)}, {_q(', '.join(x))})" for k, s, x in rules.EXPECTED) + ") AS v(vuln_type, sanitizers, signals) ON v.vuln_type = k.vuln_type",
    "taint_sources": f"{_HITS} SELECT sample_id, line::INTEGER AS line, name AS source_func FROM a",
    "taint_sinks": f"{_HITS} SELECT sample_id, line::INTEGER AS line, name AS sink_func, cat AS sink_category FROM b",
    "taint_paths": f"{PATHS_SQL} SELECT sample_id, path_no::INTEGER AS path_no, source_func, source_line::INTEGER AS source_line, sink_func, sink_line::INTEGER AS sink_line, sink_category FROM f WHERE path_no <= 20",
    "taint_functions": f"WITH {_LINES}, {_FUNCS} SELECT sample_id, name, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM fn",
    "taint_calls": f"WITH {_LINES}, {_CALLS} SELECT sample_id, caller, callee, line::INTEGER AS line FROM ce",
    "taint_callers": f"WITH RECURSIVE {_LINES}, {_CALLS}, up AS (SELECT DISTINCT sample_id, callee AS func, callee AS caller FROM ce UNION SELECT up.sample_id, up.func, ce.caller FROM up JOIN ce ON ce.sample_id = up.sample_id AND ce.callee = up.caller) SELECT sample_id, func, caller FROM up WHERE func <> caller",
    "taint_context": f"{PATHS_SQL}, {_CALLS}, tp AS (SELECT sample_id, 'Taint Analysis Results:' || chr(10) || string_agg(format('  {{}}. {{}}(line {{}}) -[direct]-> {{}}(line {{}}) [{{}}]', path_no, source_func, source_line, sink_func, sink_line, sink_category), chr(10) ORDER BY path_no) AS p FROM f WHERE path_no <= 5 GROUP BY 1), ep AS (SELECT sample_id, caller, callee, min(line) AS line FROM ce GROUP BY 1, 2, 3), eo AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY line, caller, callee) AS r FROM ep), te AS (SELECT sample_id, chr(10) || 'Relevant call graph:' || chr(10) || string_agg(format('  {{}}() -> {{}}()', caller, callee), chr(10) ORDER BY r) AS e FROM eo WHERE r <= 10 GROUP BY 1) SELECT c.sample_id, concat_ws(chr(10), p, e) AS taint_context FROM c LEFT JOIN tp USING (sample_id) LEFT JOIN te USING (sample_id)",
    "cpg_sections": f"WITH l AS (SELECT sample_id, i, trim(ls[i]) AS x FROM (SELECT sample_id, string_split(trim(output, chr(10) || ' '), chr(10)) AS ls FROM {fx.GRAPH_TOOL_SQL}), unnest(range(1, len(ls) + 1)) AS r(i)), s AS (SELECT *, CASE x WHEN '===TAINT_SOURCES===' THEN 'sources' WHEN '===TAINT_SINKS===' THEN 'sinks' WHEN '===CALL_GRAPH===' THEN 'callgraph' WHEN '===FUNCTIONS===' THEN 'functions' END AS h FROM l), w AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY i) AS section FROM s) SELECT sample_id, (i - 1)::INTEGER AS line_no, section, x AS fields FROM w WHERE h IS NULL AND section IS NOT NULL AND len(string_split(x, '|')) >= CASE WHEN section IN ('sources', 'sinks') THEN 2 ELSE 3 END",
    "triage_parse": f"WITH {_REVIEW} SELECT * FROM tv",
    "verdict_fuse": f"{_FUSE} SELECT sample_id, verdict, total AS exploits_tried, c AS exploits_confirmed FROM z",
    "verdict_confidence": f"{_FUSE} SELECT sample_id, round(CASE WHEN h < 0.5 THEN 1 - h WHEN c > 0 AND v = 'true_positive' THEN least(0.99, 0.5 * b + 0.5 * tc) WHEN c > 0 THEN b WHEN total = 0 AND v IS NULL THEN h WHEN s > 0 AND v = 'true_positive' THEN least(0.99, 0.6 * 0.9 * h + 0.4 * tc) WHEN s > 0 AND v = 'false_positive' THEN 0.6 * 0.9 * h WHEN s > 0 THEN 0.9 * h WHEN v = 'true_positive' THEN 0.5 * h + 0.5 * tc WHEN v = 'false_positive' THEN greatest(0.5, 1 - tc) ELSE 0.7 * h END, 6) AS confidence FROM z",
}
SQL["cpg_paths"] = SQL["cpg_sections"].replace("SELECT sample_id, (i - 1)", "SELECT sample_id AS sid, (i - 1)")
SQL["cpg_paths"] = (
    f"WITH f AS ({SQL['cpg_paths']}), "
    "a AS (SELECT sid, split_part(fields, '|', 1) AS source_func, split_part(fields, '|', 2)::INTEGER AS source_line FROM f WHERE section = 'sources'), "
    "b AS (SELECT sid, split_part(fields, '|', 1) AS sink_func, split_part(fields, '|', 2)::INTEGER AS sink_line FROM f WHERE section = 'sinks') "
    "SELECT a.sid AS sample_id, source_func, source_line, sink_func, sink_line, CASE sink_func "
    + " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in {s: c for c, names in reversed(rules.SINKS) for s in names}.items())
    + " ELSE 'unknown' END AS sink_category FROM a JOIN b USING (sid)"
)
