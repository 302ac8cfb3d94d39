"""Logs, programs, reviews and tool output made from the driver's tables, which have none of their own.

Each is a handful of cases dealt over all rows of a table by its key, with parts of the row put in, so that the queries
read whole tables, null columns and one sample with a third of all logs among them. ``*_SQL`` is the same in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]::VARCHAR[]"
    return repr(x)


def values(rows: list, ddl: str) -> str:
    """The same rows as a DuckDB table expression."""
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = [{"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}.get(c.split()[1], "VARCHAR[]") for c in ddl.split(", ")]
    casts = ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True))
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT {casts} FROM (VALUES {body}) AS v({', '.join(names)}))"


def dealt(spark: SparkSession, rows: DataFrame, key: str, cases: list, ddl: str) -> DataFrame:
    """Each row beside the case its key falls on; the cases are a constant few."""
    numbered = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"case_no int, {ddl}")
    return rows.withColumn("case_no", F.pmod(key, F.lit(len(cases))).cast("int")).join(F.broadcast(numbered), "case_no")


def dealt_sql(table_name: str, key: str, cases: list, ddl: str) -> str:
    return f"{table_name} r JOIN {values([(i, *c) for i, c in enumerate(cases)], f'case_no int, {ddl}')} c ON r.{key} % {len(cases)} = c.case_no"


# ---- execution logs -----------------------------------------------------------------------------------------

LOG_DDL = "exit_code int, out string, err string, timed_out boolean, expected_signals array<string>"
LOGS = [
    (1, "starting", "==7==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x60200000eff4\nWRITE of size 8 at 0x60200000eff4 thread T0\n    #0 0x51a2f0 in copy_row /src/row.c:41\n    #1 0x51b004 in main /src/main.c:9\nAddress 0x60200000eff4 is 4 bytes after a region\n", False, []),
    (0, "grid.c:18: runtime error: shift exponent 40 is too large", "", False, []),
    (-8, "dividing", None, False, []),
    (139, "", "", False, None),
    (2, "usage: tool FILE", "", False, []),
    (-9, "", "still waiting", True, []),
    (0, "all checks done", "", False, []),
    (0, "report: Stale-Handle seen twice", "", False, ["nothing", "stale-handle"]),
    (1, "", "free(): invalid pointer", False, []),
    (0, "", "Invalid write of size 8\nERROR SUMMARY: 4 errors from 2 contexts", False, []),
    (0, "", "definitely lost: 96 bytes in 3 blocks\nERROR SUMMARY: 0 errors", False, []),
    (0, "", "Conditional jump or move depends on uninitialised value(s)\nERROR SUMMARY: 12 errors", False, []),
    (77, "", "WARNING: MemorySanitizer: use-of-uninitialized-value\n    #0 0x4f in f /src/f.c:3", False, []),
    (66, "", "WARNING: ThreadSanitizer: lock-order-inversion (pid=31)", False, []),
    (3, "", "fatal: cannot map file", False, []),
    (-11, "", "AddressSanitizer: stack-use-after-return\nSegmentation fault", False, []),
    (134, "assertion failed: n > 0", "", False, []),
    (0, "", "runtime error: null pointer passed as argument 1", False, []),
    (0, "PANIC avoided", "", False, []),
    (4, "", "", True, []),
    (0, "", "ThreadSanitizer: data race\nAddressSanitizer: double-free\nHEAP SUMMARY", False, []),
    (5, None, None, None, None),
]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, sample_id, ord, exit_code, stdout, stderr, timed_out, expected_signals: one log an event."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return dealt(spark, rows, "event_id", LOGS, LOG_DDL).select(
        F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("sample_id"),
        F.col("event_id").alias("ord"), "exit_code", F.concat("out", F.lit("\n"), "event_type").alias("stdout"),
        F.col("err").alias("stderr"), "timed_out", "expected_signals",
    )


LOGS_SQL = f"""(SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS sample_id, event_id AS ord, exit_code,
  out || chr(10) || event_type AS stdout, err AS stderr, timed_out, expected_signals FROM {dealt_sql("events", "event_id", LOGS, LOG_DDL)})"""

# ---- programs -----------------------------------------------------------------------------------------------

CODE_DDL = "program string"
CODES = [
    ("#include <stdio.h>\nvoid load_@(char *from) {\n  char to[16];\n  strcpy(to, from); // whole line\n}\nint main(int argc, char **argv) {\n  load_@(argv[1]);\n  return 0;\n}",),
    ('int start_@(int n) {\n  popen(getenv("SHELL_LINE"), "r");\n  return n;\n}',),
    ('int main() {\n  puts("a string /* kept */ here");\n  return 0;\n}',),
    ('static int head_@(const char *p) {\n  char buf[32]; /* two\n lines */\n  sprintf(buf, "%s", p);\n  if (buf[0]) { gets(buf); }\n  return tail_@(buf);\n}\nint tail_@(char *q) { return read(0, q, 8); }\nvoid all_@(void) {\n  head_@(stdin);\n}',),
    ('int limit_@ = 3;\nchar *title = "it\'s";\n\n  // data only\n',),
    ("while (1) {\n  fgets(line, 64, stdin);\n  fprintf(out, line);\n}",),
    (None,),
]


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, code: a program before each document's text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = F.replace("program", F.lit("@"), (F.col("doc_id") % 97).cast("string"))
    return dealt(spark, rows, "doc_id", CODES, CODE_DDL).select(F.col("doc_id").alias("sample_id"), F.concat(own, F.lit("\n"), "text").alias("code"))


CODES_SQL = f"(SELECT doc_id AS sample_id, replace(program, '@', (doc_id % 97)::VARCHAR) || chr(10) || text AS code FROM {dealt_sql('documents', 'doc_id', CODES, CODE_DDL)})"

# ---- reviews, scores, tool output, types --------------------------------------------------------------------

REVIEW_DDL = "reply string"
REVIEWS = [
    ('{"verdict": "true_positive", "confidence": 0.9@, "reasoning": "row @ is copied unchecked"}',),
    ('```json\n{"verdict": "false_positive", "confidence": 0.8@, "reasoning": "length is tested"}\n```',),
    ('Looking at it: {"verdict": "true_positive", "confidence": 1.7} is my answer',),
    ('{"verdict": "perhaps", "confidence": -@, "reasoning": "cannot tell"}',),
    ("nothing to parse in @",),
    ('{"verdict": "uncertain", "confidence": "rather high"}',),
    ('```c\nint main(void) { return @; }\n```\nand ```json\n{"harness": {"n": @}}\n```',),
    (None,),
]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, response: one a document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    own = F.replace("reply", F.lit("@"), (F.col("n_chars") % 100).cast("string"))
    return dealt(spark, rows, "doc_id", REVIEWS, REVIEW_DDL).select(F.col("doc_id").alias("sample_id"), own.alias("response"))


REVIEWS_SQL = f"(SELECT doc_id AS sample_id, replace(reply, '@', (n_chars % 100)::VARCHAR) AS response FROM {dealt_sql('documents', 'doc_id', REVIEWS, REVIEW_DDL)})"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, hybrid_score: one a document."""
    score = (F.pmod(F.col("n_chars") * 37, F.lit(101)) / 100.0).cast("double")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), score.alias("hybrid_score"))


PREDICTIONS_SQL = "(SELECT doc_id AS sample_id, ((n_chars * 37) % 101)::DOUBLE / 100.0::DOUBLE AS hybrid_score FROM documents)"

GRAPH_TOOL_DDL = "printed string"
GRAPH_TOOL = [
    ("warming up\n===TAINT_SOURCES===\nargv|@\nrecv|9\n===TAINT_SINKS===\nstrcat|5\npopen|@\nodd\n===CALL_GRAPH===\nmain|work|3\nwork|strcat|-1\ntwo|fields\n===FUNCTIONS===\nmain|1|@\n",),
    ("===TAINT_SOURCES===\nstdin|1\n===TAINT_SINKS===\n===FUNCTIONS===\ng|@|-1",),
    ("  \n===TAINT_SINKS===\nmemcpy|@\nnovel_sink|4\n===TAINT_SOURCES===\nfread|@\nfread|2",),
]


def graph_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, output: one a document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    own = F.replace("printed", F.lit("@"), (F.col("n_chars") % 100).cast("string"))
    return dealt(spark, rows, "doc_id", GRAPH_TOOL, GRAPH_TOOL_DDL).select(F.col("doc_id").alias("sample_id"), own.alias("output"))


GRAPH_TOOL_SQL = f"(SELECT doc_id AS sample_id, replace(printed, '@', (n_chars % 100)::VARCHAR) AS output FROM {dealt_sql('documents', 'doc_id', GRAPH_TOOL, GRAPH_TOOL_DDL)})"

KIND_DDL = "vuln_type string"
KINDS = [("buffer_overflow",), ("uninitialized_read",), ("race_condition",), ("integer_overflow",), ("toctou",), ("off_by_one",), ("use_after_free",), (None,)]


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, vuln_type: one a document."""
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return dealt(spark, rows, "doc_id", KINDS, KIND_DDL).select(F.col("doc_id").alias("sample_id"), "vuln_type")


KINDS_SQL = f"(SELECT doc_id AS sample_id, vuln_type FROM {dealt_sql('documents', 'doc_id', KINDS, KIND_DDL)})"
