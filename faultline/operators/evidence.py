"""Classification of execution logs: which messages a log holds, and what that proves.

Rules are constants, so a log is tested against each in one projection: no join with a pattern table, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import strip
from ..rules import (
    CATEGORY_CONFIDENCE, CATEGORY_SOURCE, CWE, DIRECT, EXPECTED, MAX_OUTPUT, PROFILES, SIGNALS, SUGGESTIVE, VALGRIND,
)


def combined(stdout: Column, stderr: Column) -> Column:
    return F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))


def _held(text: Column, patterns) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(p)) for p in patterns]))


def direct_matches(text: Column) -> Column:
    """Array of (category, pattern) found, in rule order."""
    return F.array_compact(
        F.array(*[F.when(text.rlike(p), F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern"))) for c, ps in DIRECT for p in ps])
    )


def signal_name(exit_code: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in SIGNALS:
        out = F.when(exit_code == code, F.lit(name)).otherwise(out)
    return out


def valgrind_errors(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, rules.ERROR_SUMMARY, 1).try_cast("int"), F.lit(0))


def cwe_id(text: Column, matched: Column) -> Column:
    """The weakness of the first message, in order of precedence, that the text holds; empty without a direct match."""
    found = F.coalesce(*[F.when(F.contains(text, F.lit(key)), F.lit(cwe)) for key, cwe in CWE], F.lit(""))
    return F.when(F.size(matched) > 0, found).otherwise("")


def sanitizer_source(categories: Column) -> Column:
    out = F.lit("")
    for category, name in reversed(CATEGORY_SOURCE):
        out = F.when(F.array_contains(categories, category), F.lit(name)).otherwise(out)
    return out


def direct_confidence(categories: Column, any_valgrind: Column, signal: Column) -> Column:
    base = F.greatest(F.lit(0.7), *[F.when(F.array_contains(categories, c), F.lit(x)).otherwise(0.0) for c, x in CATEGORY_CONFIDENCE])
    for more, when in ((0.05, F.size(categories) > 1), (0.03, any_valgrind), (0.02, signal.isNotNull())):
        base = F.when(when, F.least(base + more, F.lit(1.0))).otherwise(base)
    return F.round(base, 3)


def asan_report(text: Column) -> Column:
    """Error type, access, address, description and stack frames of an AddressSanitizer report."""
    frames = F.regexp_extract_all(text, F.lit(rules.REPORT_FRAME), F.lit(0))
    return F.struct(
        F.regexp_extract(text, rules.REPORT_ERROR, 1).alias("error_type"),
        F.regexp_extract(text, rules.REPORT_ACCESS, 1).alias("access_type"),
        F.coalesce(F.regexp_extract(text, rules.REPORT_ACCESS, 2).try_cast("int"), F.lit(0)).alias("access_size"),
        F.regexp_extract(text, rules.REPORT_ACCESS, 3).alias("address"),
        F.regexp_extract(text, rules.REPORT_ADDRESS, 1).alias("description"),
        F.transform(frames, lambda f: F.concat(F.lit("#"), F.regexp_extract(f, rules.REPORT_FRAME_PARTS, 1), F.lit(" "), F.regexp_extract(f, rules.REPORT_FRAME_PARTS, 2), F.lit(" ("), strip(F.regexp_extract(f, rules.REPORT_FRAME_PARTS, 3)), F.lit(")"))).alias("stack_frames"),
    )


def classify(logs: DataFrame) -> DataFrame:
    """Adds level, reason, matched_patterns, confidence, asan_report, valgrind_errors, cwe_id, sanitizer_source.

    ``logs`` has exit_code, stdout, stderr, timed_out and expected_signals.
    """
    text = combined(F.col("stdout"), F.col("stderr"))
    late = F.coalesce(F.col("timed_out"), F.lit(False))
    found = (
        logs.withColumn("__text", text)
        .withColumn("__direct", direct_matches(F.col("__text")))
        .withColumn("__valgrind", _held(F.col("__text"), VALGRIND))
        .withColumn("__hints", _held(F.col("__text"), SUGGESTIVE))
        .withColumn("__categories", F.array_distinct(F.transform("__direct", lambda m: m["category"])))
        .withColumn("__signal", signal_name(F.col("exit_code")))
        .withColumn("__expected", F.get(F.filter(F.coalesce("expected_signals", F.array().cast("array<string>")), lambda s: F.contains(F.lower(F.col("__text")), F.lower(s))), 0))
        .withColumn("__errors", valgrind_errors(F.col("__text")))
    )
    valgrind, hints, exit_code = F.col("__valgrind"), F.col("__hints"), F.col("exit_code")
    patterns = F.transform("__direct", lambda m: m["pattern"])
    nothing = F.array().cast("array<string>")
    said = F.array_join(F.transform(F.slice("__direct", 1, 5), lambda m: F.concat_ws(": ", m["category"], m["pattern"])), "; ")
    invalid = F.exists(valgrind, lambda p: F.contains(p, F.lit("Invalid")))
    leaked = F.exists(valgrind, lambda p: F.contains(p, F.lit("definitely lost"))) | (F.col("__errors") > 0)

    def step(level: str, confidence, reason, matched, source=None, cwe=None) -> Column:
        return F.struct(
            F.lit(level).alias("level"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"),
            (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), matched.alias("matched_patterns"),
            (source if source is not None else F.lit("")).alias("sanitizer_source"), (cwe if cwe is not None else F.lit("")).alias("cwe_id"),
        )

    ladder = (
        F.when(F.size("__direct") > 0, step("CONFIRMED", direct_confidence(F.col("__categories"), F.size(valgrind) > 0, F.col("__signal")), F.concat(F.lit(rules.REASON_DIRECT), said), patterns, sanitizer_source(F.col("__categories")), cwe_id(F.col("__text"), F.col("__direct"))))
        .when(F.col("__signal").isNotNull(), step("CONFIRMED", 0.9, F.format_string(rules.REASON_SIGNAL, "__signal", exit_code.cast("int")), F.array("__signal")))
        .when(F.col("__expected").isNotNull(), step("CONFIRMED", 0.85, F.concat(F.lit(rules.REASON_EXPECTED), F.col("__expected")), F.array("__expected")))
        .when(invalid, step("CONFIRMED", 0.85, rules.REASON_INVALID_ACCESS, valgrind, F.lit("valgrind")))
        .when((F.size(valgrind) > 0) & leaked, step("SUGGESTIVE", 0.6, F.format_string(rules.REASON_LEAK, "__errors"), valgrind, F.lit("valgrind"), F.lit("CWE-401")))
        .when((exit_code != 0) & ~late & (F.size(hints) > 0), step("SUGGESTIVE", 0.5, F.concat(F.format_string(rules.REASON_SUSPICIOUS, exit_code.cast("int")), F.array_join(F.slice(hints, 1, 3), "; ")), hints))
        .when((exit_code != 0) & ~late, step("SUGGESTIVE", 0.3, F.format_string(rules.REASON_EXIT, exit_code.cast("int")), nothing))
        .when(late, step("NEUTRAL", 0.0, rules.REASON_TIMEOUT, nothing))
        .when(F.size(hints) == 0, step("SAFE", 1.0, rules.REASON_CLEAN, nothing))
        .otherwise(step("NEUTRAL", 0.0, rules.REASON_UNCLEAR, nothing))
    )
    report = F.when(F.array_contains("__categories", "ASAN"), asan_report(F.col("__text")))
    return (
        found.withColumn("__out", ladder)
        .withColumn("asan_report", report)
        .withColumn("valgrind_errors", F.col("__errors"))
        .select(*logs.columns, "__out.*", "asan_report", "valgrind_errors")
    )


def execution_log(raw: DataFrame, returncode: str = "returncode") -> DataFrame:
    """From raw tool output: exit_code stated in it (else the return code), compiled, the valgrind section, cut outputs."""
    output = combined(F.col("stdout"), F.col("stderr"))
    section = strip(F.regexp_extract(output, rules.VALGRIND_SECTION, 1))
    compiled = F.contains(output, F.lit(rules.COMPILED))
    return raw.select(
        *[c for c in raw.columns if c not in ("stdout", "stderr", returncode)],
        F.coalesce(F.regexp_extract(output, rules.EXIT_STATED, 1).try_cast("int"), F.col(returncode)).alias("exit_code"),
        F.coalesce("stdout", F.lit("")).alias("stdout"),
        F.when(section != "", F.concat(F.coalesce("stderr", F.lit("")), F.lit("\n"), section)).otherwise(F.coalesce("stderr", F.lit(""))).alias("stderr"),
        compiled.alias("compiled"), F.substring(section, 1, MAX_OUTPUT).alias("valgrind_output"),
        F.when(compiled, F.lit("")).otherwise(F.substring(output, 1, MAX_OUTPUT)).alias("compilation_error"),
    )


def cut_outputs(rows: DataFrame, columns=("stdout", "stderr"), n: int = MAX_OUTPUT) -> DataFrame:
    """Outputs cut for keeping, after classification."""
    return rows.withColumns({c: F.substring(c, 1, n) for c in columns})


def until_first(rows: DataFrame, group: str, order: str, stop: Column) -> DataFrame:
    """Rows of a group up to and including the first that satisfies ``stop``; one aggregate row per group is joined."""
    first = rows.filter(stop).groupBy(group).agg(F.min(order).alias("__stop"))
    out = rows.join(first, group, "left").filter(F.col("__stop").isNull() | (F.col(order) <= F.col("__stop")))
    return out.drop("__stop")


def cap(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def profiles(kinds: DataFrame, kind: str = "vuln_type") -> DataFrame:
    """The sanitizer profiles that detect a type, one row each; the first profile where none does."""
    detects = F.array_compact(F.array(*[F.when(F.col(kind).isin(*types), F.lit(name)) for name, types in PROFILES]))
    chosen = F.when(F.size(detects) > 0, detects).otherwise(F.array(F.lit(PROFILES[0][0])))
    return kinds.withColumn("profile", F.explode(chosen))


def expectations(kinds: DataFrame, kind: str = "vuln_type") -> DataFrame:
    """Adds the sanitizers a type is built with and the signals its log is expected to hold; none for an unknown type."""
    def looked_up(values: list[Column], default: Column) -> Column:
        found = default
        for (name, _, _), value in zip(EXPECTED, values, strict=True):
            found = F.when(F.col(kind) == name, value).otherwise(found)
        return found

    none = F.array().cast("array<string>")
    return kinds.withColumns({
        "sanitizers": looked_up([F.lit(s) for _, s, _ in EXPECTED], F.lit("")),
        "expected_signals": looked_up([F.array(*[F.lit(x) for x in signals]) for _, _, signals in EXPECTED], none),
    })


def rollup(evidence: DataFrame, group: str = "sample_id", order: str = "ord") -> DataFrame:
    """Per sample: confirmed, suggestive, total, max_confidence of confirmed rows, the weakness and source of the first."""
    yes = F.col("evidence_level") == "CONFIRMED"
    return evidence.groupBy(group).agg(
        F.count_if(yes).alias("confirmed"), F.count_if(F.col("evidence_level") == "SUGGESTIVE").alias("suggestive"),
        F.count(F.lit(1)).alias("total"), F.max(F.when(yes, F.col("confidence"))).alias("max_confidence"),
        F.coalesce(F.min_by("cwe_id", F.when(yes & (F.col("cwe_id") != ""), F.col(order))), F.lit("")).alias("cwe_id"),
        F.coalesce(F.min_by("sanitizer_source", F.when(yes & (F.col("sanitizer_source") != ""), F.col(order))), F.lit("")).alias("sanitizer_source"),
    )
