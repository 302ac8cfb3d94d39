"""Queries through files: driver tables written in each format, read back by the engine's readers and writers.

Files lie in the shared folder. A format that is one object, array or text a file gets one file a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, evidence, report, selection
from ..sources import readers, writers
from ..streaming import index as stream
from . import fixtures as fx
from .lineage import place

RAW_LINES, ARRAY_ITEMS, OUTPUT_CHARS = 700, 50, 40


def _lines(rows: DataFrame, line: Column, label: str, one_a_file: bool = False) -> str:
    path = place(rows.sparkSession, label)
    writer = rows.select(line.alias("value")).write
    (writer.option("maxRecordsPerFile", 1) if one_a_file else writer).text(path)
    return path


def _case(key: str, cases: list[Column]) -> Column:
    at = F.pmod(key, F.lit(len(cases)))
    out = cases[-1]
    for i, c in reversed(list(enumerate(cases[:-1]))):
        out = F.when(at == i, c).otherwise(out)
    return out


# ---- sources ------------------------------------------------------------------------------------------------


def source_training_jsonl(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    path = place(spark, "training")
    docs.select(F.col("doc_id").alias("idx"), F.col("text").alias("func"), (F.col("doc_id") % 2).cast("int").alias("target"), F.col("source").alias("project"), F.col("lang").alias("commit_id")).write.json(path)
    return readers.training_jsonl(spark, path)


def _sample_lines(docs: DataFrame) -> DataFrame:
    """doc_id, value: whole, without its brace, without a target, padded, broken and empty lines."""
    code = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit("")))
    whole = F.to_json(F.struct(code.alias("func"), (F.col("doc_id") % 2).alias("target")))
    bare = F.to_json(F.struct(code.alias("func")))
    cases = [whole, F.substring(whole, 2, 1 << 30), bare, F.concat(F.lit("  "), whole, F.lit(" ")), F.lit('{"func": no'), F.lit(" "), F.lit("said nothing")]
    return docs.select("doc_id", _case("doc_id", cases).alias("value"))


def source_repairing_jsonl(spark, sf_dir):
    lines = _sample_lines(fx.table(spark, sf_dir, "documents"))
    return readers.repairing_jsonl(spark, _lines(lines, F.col("value"), "repairing"))


def source_rejects(spark, sf_dir):
    """What became of each raw line of the repairing and the catalogue reader: rows, and what gave none, by reason."""
    lines = _sample_lines(fx.table(spark, sf_dir, "documents"))
    path = _lines(lines, F.col("value"), "raw-lines")
    outcomes = []
    for reader, rows, rejects in (
        ("repairing", readers.repairing_jsonl(spark, path), readers.repairing_rejects(spark, path)),
        ("catalogue", readers.catalogue_jsonl(spark, path), readers.catalogue_rejects(spark, path)),
    ):
        outcomes += [rows.select(F.lit(reader).alias("reader"), F.lit("row").alias("outcome")), rejects.select(F.lit(reader).alias("reader"), F.col("reason").alias("outcome"))]
    every = outcomes[0]
    for more in outcomes[1:]:
        every = every.unionByName(more)
    return every.groupBy("reader", "outcome").agg(F.count(F.lit(1)).alias("n"))


def source_batch_jsonl(spark, sf_dir):
    """The first raw lines of a folder of files, blank ones counted; both names of code and label."""
    docs = fx.table(spark, sf_dir, "documents")
    code = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit("")))
    label = (F.col("doc_id") % 2).cast("string")
    cases = [
        F.to_json(F.struct(code.alias("func"), (F.col("doc_id") % 2).alias("target"))), F.to_json(F.struct(code.alias("code"), label.alias("label"))),
        F.lit(""), F.to_json(F.struct(F.lit("  ").alias("func"))), F.to_json(F.struct(code.alias("func"))),
    ]
    ordered = docs.orderBy("doc_id")  # a file a range
    return readers.batch_jsonl(spark, _lines(ordered, _case("doc_id", cases), "batch"), RAW_LINES)


def source_json_array(spark, sf_dir):
    items = fx.table(spark, sf_dir, "benchmark")
    entry = F.struct(F.col("item_id").alias("idx"), F.col("text").alias("func"), (F.col("item_id") % 2).cast("int").alias("target"))
    arrays = items.groupBy((F.col("item_id") / ARRAY_ITEMS).cast("long")).agg(F.collect_list(entry).alias("a"))  # at most so many each
    path = _lines(arrays, F.to_json("a"), "arrays", one_a_file=True)
    return readers.json_array(spark, path).select("idx", "func", "target")


def source_split_ids(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("i"))
    return readers.split_ids(spark, _lines(ids.union(ids), F.concat(F.lit(" "), "i"), "splits"))


def template_folder(spark, sf_dir) -> str:
    """A folder of template files, one a benchmark text."""
    items = fx.table(spark, sf_dir, "benchmark")
    entry = F.struct(
        F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("exploit_id"), F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("kind "), (F.col("item_id") % 3).cast("string"))).alias("vuln_type"),
        F.col("text").alias("harness_template"), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"),
        F.when(F.col("item_id") % 4 == 0, F.col("item_id").cast("int")).alias("timeout_sec"),
    )
    path = place(spark, "templates")
    items.select(entry.alias("e")).select("e.*").write.option("maxRecordsPerFile", 1).json(path)
    return path


def _entries(spark, sf_dir) -> str:
    docs = fx.table(spark, sf_dir, "documents")
    entry = F.to_json(F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("exploit_id"), F.col("source").alias("vuln_type"), F.col("lang").alias("language"), F.array("source").alias("expected_signals")))
    return _lines(docs, _case("doc_id", [entry, F.lit("not an entry"), entry, F.lit("")]), "catalogue")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.array_join(c, "|") for c in ("tags", "expected_signals")})


def source_template_catalogue(spark, sf_dir):
    return _flat(readers.template_catalogue(spark, template_folder(spark, sf_dir)))


def source_catalogue_jsonl(spark, sf_dir):
    rows = readers.catalogue_jsonl(spark, _entries(spark, sf_dir))
    none = readers.catalogue_jsonl(spark, place(spark, "missing"))
    return _flat(rows.unionByName(none)).select("exploit_id", "vuln_type", "language", "timeout_sec", "expected_signals", "tags")


def source_catalogue_union(spark, sf_dir):
    rows = readers.catalogue(spark, template_folder(spark, sf_dir), _entries(spark, sf_dir))
    return rows.groupBy("vuln_type").agg(F.count(F.lit(1)).alias("n"), F.min("exploit_id").alias("first_id"))


def source_files(spark, sf_dir):
    """One sample a file, and one given inline."""
    path = _lines(fx.table(spark, sf_dir, "benchmark"), F.col("text"), "files", one_a_file=True)
    return readers.source_file(spark, path).unionByName(readers.inline(spark, "int inline_sample;")).select("code")


def _vectors(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _digest(index: DataFrame) -> DataFrame:
    parts = {f"e{i}": F.get("embedding", i).cast("double") for i in (0, 31, 63)}
    return index.select("vec_id", "label", F.size("embedding").alias("dims"), *[c.alias(n) for n, c in parts.items()])


def index_save_load(spark, sf_dir):
    path = place(spark, "index")
    writers.index(_vectors(spark, sf_dir), path)
    return _digest(readers.vector_index(spark, path))


def index_append(spark, sf_dir):
    """Grown by append; rows that come again stay twice."""
    v, path = _vectors(spark, sf_dir), place(spark, "grown")
    writers.index(v.filter("vec_id % 2 = 0"), path)
    writers.index(v.filter("vec_id % 2 = 1 or vec_id % 10 = 0"), path, "append")
    return readers.vector_index(spark, path).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))


def index_stream_append(spark, sf_dir):
    """Grown from a stream of new rows in two runs of one checkpoint: each row arrives once."""
    v = _vectors(spark, sf_dir)
    new, path, marks = place(spark, "new"), place(spark, "streamed"), place(spark, "stream-marks")
    for part in ("vec_id % 2 = 0", "vec_id % 2 = 1"):
        v.filter(part).write.mode("append").parquet(new)
        stream.append_index(spark.readStream.schema(v.schema).parquet(new), path, marks).awaitTermination()
    return readers.vector_index(spark, path).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))


def index_rebuild(spark, sf_dir):
    """Rebuilt from itself and more, in place."""
    v, path = _vectors(spark, sf_dir), place(spark, "rebuilt")
    writers.index(v, path)
    writers.rebuild_index([readers.vector_index(spark, path), v.filter("label >= 5")], path)
    return readers.vector_index(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("ids"))


def source_word_vectors(spark, sf_dir):
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")
    word = F.concat(F.lit("word"), F.col("vec_id").cast("string"))
    line = _case("vec_id", [F.concat_ws(" ", word, numbers), F.concat(F.lit(" "), F.concat_ws(" ", word, numbers), F.lit(" ")), F.concat(word, F.lit(" 64"))])
    rows = readers.word_vectors(spark, _lines(_vectors(spark, sf_dir), line, "words"))
    return rows.select("word", F.size("vector").alias("dims"), F.get("vector", 0).cast("double").alias("e0"), F.get("vector", 63).cast("double").alias("e63"))


def _raw_logs(spark, sf_dir) -> DataFrame:
    """What a run printed: an exit code of its own in some, a compiler's mark, a section of a memory checker."""
    code = F.concat(F.lit("EXIT_CODE="), (F.col("event_id") % 140).cast("string"))
    mark, section = F.lit("===COMPILATION_OK===\n"), F.concat(F.lit("===VALGRIND_START===\n Invalid read of size "), (F.col("event_id") % 9).cast("string"), F.lit("\n===VALGRIND_END===\n"))
    said = _case("event_id", [F.concat(mark, code), F.concat(mark, section, F.col("props")), F.concat(F.lit("error: "), F.col("props")), mark, F.lit(None).cast("string")])
    return fx.table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % 3).cast("int").alias("returncode"), said.alias("stdout"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("stderr")
    )


def exec_log_parse(spark, sf_dir):
    return evidence.execution_log(_raw_logs(spark, sf_dir))


def exec_log_cut(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("stdout"), F.col("source").alias("stderr"))
    return evidence.cut_outputs(docs, n=OUTPUT_CHARS)


# ---- sinks --------------------------------------------------------------------------------------------------


def sink_splits(spark, sf_dir):
    docs, labels = fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels")
    splits = {"train": labels.filter("quality = 1").select("doc_id"), "test": labels.filter("toxic = 1").select("doc_id")}
    path = place(spark, "split-files")
    writers.splits(selection.assign_split(docs.select("doc_id", "text"), splits, "doc_id"), path)
    return spark.read.schema("doc_id long, text string, split string").json(path)


def sink_predictions(spark, sf_dir):
    path = place(spark, "predictions")
    scored = fx.predictions(spark, sf_dir)
    writers.predictions_tsv(scored.select(F.col("sample_id").alias("idx"), (F.col("hybrid_score") > 0.5).alias("prediction")), path)
    return spark.read.schema("idx long, prediction int").option("sep", "\t").csv(path)


def sink_results(spark, sf_dir):
    path = place(spark, "results")
    rows = fx.predictions(spark, sf_dir).select(F.col("sample_id").alias("index"), (F.col("sample_id") % 2).cast("int").alias("label"), F.struct("hybrid_score", F.lit("SAFE").alias("verdict")).alias("result"))
    writers.results_json(rows, path)
    read = spark.read.schema("index long, label int, result struct<hybrid_score:double,verdict:string>").json(path)
    return read.select("index", "label", "result.hybrid_score", "result.verdict")


METRICS_DDL = "mode string, total long, accuracy double, precision double, recall double, f1 double, true_positives long, true_negatives long, false_positives long, false_negatives long, fp_reduction double, exploitation_rate double, avg_time double, median_time double"


def sink_metrics(spark, sf_dir):
    """The evaluation file with all its keys, written and read again."""
    path, n = place(spark, "metrics"), F.col("sample_id")
    rows = fx.predictions(spark, sf_dir).select(
        (F.col("hybrid_score") > 0.5).cast("int").alias("prediction"), (F.col("hybrid_score") > 0.3).cast("int").alias("before"), (n % 2).cast("int").alias("label"),
        (n % 4).alias("tried"), F.when(n % 3 == 0, n % 4).otherwise(0).alias("confirmed"), (n * 13 % 97 / 8).cast("double").alias("seconds"),
    )
    writers.metrics_json(evaluation.summary(rows, "full", before="before", tried="tried", confirmed="confirmed", seconds="seconds"), path)
    return spark.read.schema(METRICS_DDL).json(path)


def _results(spark, sf_dir) -> DataFrame:
    """Scan results with and without tried runs and reviews."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    share = lambda k, n: (F.pmod(F.col("n_chars") * k, F.lit(n)) / float(n)).cast("double")
    verdict = _case("doc_id", [F.lit(v) for v in ("CONFIRMED", "SUGGESTIVE", "NEUTRAL", "SAFE")])
    detail = F.struct(
        F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("exploit_id"), F.lit("CONFIRMED").alias("evidence_level"), F.lit("seen").alias("reason"),
        F.lit(-11).alias("exit_code"), F.lit(0.25).alias("execution_time"), (F.col("doc_id") % 3 == 0).alias("compiled"),
    )
    reviewed = F.col("doc_id") % 5 < 2
    return docs.select(
        F.col("doc_id").alias("sample_id"), verdict.alias("verdict"), share(1, 4).alias("confidence"), share(3, 8).alias("cls_prob"), share(5, 8).alias("faiss_score"),
        share(7, 8).alias("hybrid_score"), F.lit("buffer_overflow").alias("vuln_type"), share(9, 4).alias("vuln_type_confidence"),
        (F.col("doc_id") % 3).cast("int").alias("exploits_tried"), (F.col("doc_id") % 2).cast("int").alias("exploits_confirmed"),
        F.when(F.col("doc_id") % 3 > 0, F.array(detail, detail)).otherwise(F.array().cast("array<struct<exploit_id:string,evidence_level:string,reason:string,exit_code:int,execution_time:double,compiled:boolean>>")).alias("evidence_details"),
        share(11, 4).alias("total_time"), F.lit("CWE-121").alias("cwe_id"), F.lit("asan").alias("sanitizer_source"), F.substring("text", 1, 20).alias("taint_context"),
        F.when(reviewed, "true_positive").otherwise("").alias("triage_verdict"), share(13, 4).alias("triage_confidence"), F.coalesce("text", F.lit("")).alias("triage_reasoning"),
    )


def report_json(spark, sf_dir):
    """The fields of each result's JSON, read out of it again; review fields stand only where there is a review."""
    j = report.result_json(_results(spark, sf_dir))
    texts = ("verdict", "vuln_type", "cwe_id", "sanitizer_source", "taint_context", "triage_verdict", "triage_reasoning")
    numbers = ("confidence", "hybrid_score", "exploits_tried", "total_time", "triage_confidence")
    return j.select(
        "sample_id", *[F.get_json_object("json", f"$.{c}").alias(c) for c in texts], *[F.get_json_object("json", f"$.{c}").cast("double").alias(c) for c in numbers],
        F.get_json_object("json", "$.evidence_details[1].exploit_id").alias("second_exploit"), F.contains("json", F.lit('"triage_')).alias("reviewed"),
    )


def report_text(spark, sf_dir):
    return report.result_report(_results(spark, sf_dir), verbose=True)


def report_summary(spark, sf_dir):
    return report.batch_summary(_results(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        source_training_jsonl, source_repairing_jsonl, source_rejects, source_batch_jsonl, source_json_array, source_split_ids,
        source_template_catalogue, source_catalogue_jsonl, source_catalogue_union, source_files, source_word_vectors,
        index_save_load, index_append, index_stream_append, index_rebuild, exec_log_parse, exec_log_cut, sink_splits,
        sink_predictions, sink_results, sink_metrics, report_json, report_text, report_summary,
    )
}

_CODE = "doc_id || ':' || coalesce(text, '')"
_TEMPLATES = """SELECT 't' || item_id AS exploit_id, CASE WHEN item_id % 3 > 0 THEN 'kind ' || (item_id % 3) ELSE '' END AS vuln_type, text AS harness_template,
  CASE WHEN item_id % 2 = 0 THEN 'a|b' ELSE '' END AS tags, CASE WHEN item_id % 4 = 0 THEN item_id::INTEGER ELSE 30 END AS timeout_sec FROM benchmark"""
_ENTRIES = "SELECT 'd' || doc_id AS exploit_id, coalesce(source, '') AS vuln_type, coalesce(lang, 'c') AS language, 30 AS timeout_sec, coalesce(source, '') AS expected_signals, '' AS tags FROM documents WHERE doc_id % 4 IN (0, 2)"
_PARTS = "len(embedding)::INTEGER AS dims, embedding[1]::DOUBLE AS e0, embedding[32]::DOUBLE AS e31, embedding[64]::DOUBLE AS e63"
_GROWN = "SELECT vec_id, count(*) AS n, max(label) AS label FROM"
_RAW = """raw AS (SELECT event_id, (event_id % 3)::INTEGER AS returncode, CASE WHEN event_id % 2 = 0 THEN event_type END AS stderr,
  CASE event_id % 5 WHEN 0 THEN '===COMPILATION_OK===' || chr(10) || 'EXIT_CODE=' || (event_id % 140)
    WHEN 1 THEN '===COMPILATION_OK===' || chr(10) || '===VALGRIND_START===' || chr(10) || ' Invalid read of size ' || (event_id % 9) || chr(10) || '===VALGRIND_END===' || chr(10) || props
    WHEN 2 THEN 'error: ' || props WHEN 3 THEN '===COMPILATION_OK===' || chr(10) END AS stdout FROM events),
o AS (SELECT *, coalesce(stdout, '') || chr(10) || coalesce(stderr, '') AS t FROM raw),
s AS (SELECT *, trim(regexp_extract(t, '(?s)===VALGRIND_START===(.*?)===VALGRIND_END===', 1), ' ' || chr(10)) AS section, contains(t, '===COMPILATION_OK===') AS compiled FROM o)"""
_SHARE = "((n_chars * {0}) % {1})::DOUBLE / {1}::DOUBLE".format
_RESULTS = f"""r AS (SELECT doc_id AS sample_id, CASE doc_id % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'SUGGESTIVE' WHEN 2 THEN 'NEUTRAL' ELSE 'SAFE' END AS verdict,
  {_SHARE(1, 4)} AS confidence, {_SHARE(3, 8)} AS cls_prob, {_SHARE(5, 8)} AS faiss_score, {_SHARE(7, 8)} AS hybrid_score, {_SHARE(9, 4)} AS type_conf,
  (doc_id % 3)::INTEGER AS tried, (doc_id % 2)::INTEGER AS confirmed, {_SHARE(11, 4)} AS total_time, text, doc_id % 5 < 2 AS reviewed, {_SHARE(13, 4)} AS tc FROM documents)"""
_PERCENT = "format('{{:.2f}}%', {} * 100)".format


def _detail(n: int) -> str:
    lines = [f"    --- Exploit #{n}: x{{}} ---", "    Evidence:   CONFIRMED", "    Reason:     seen", "    Exit code:  -11", "    Compiled:   {}", "    Time:       0.25s"]
    return "format('\n" + "\n".join(lines) + "', sample_id, CASE WHEN sample_id % 3 = 0 THEN 'True' ELSE 'False' END)"


_RULE = "=" * 60
_N = "chr(10)"
SQL = {
    "source_training_jsonl": "SELECT doc_id AS idx, text AS func, (doc_id % 2)::INTEGER AS target, source AS project, lang AS commit_id FROM documents",
    "source_repairing_jsonl": f"SELECT {_CODE} AS func, CASE WHEN doc_id % 7 = 2 THEN 0 ELSE doc_id % 2 END::INTEGER AS target FROM documents WHERE doc_id % 7 < 4",
    "source_rejects": "SELECT reader, CASE WHEN c = 5 THEN 'blank' WHEN c = 4 OR c = 6 THEN 'not JSON' WHEN reader = 'catalogue' AND c = 1 THEN 'not an object' ELSE 'row' END AS outcome, count(*) AS n FROM (SELECT doc_id % 7 AS c FROM documents), (VALUES ('repairing'), ('catalogue')) AS r(reader) GROUP BY 1, 2",
    "source_batch_jsonl": f"SELECT line_no, {_CODE} AS code, CASE WHEN doc_id % 5 = 4 THEN -1 ELSE doc_id % 2 END::INTEGER AS label FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents) WHERE line_no < {RAW_LINES} AND doc_id % 5 IN (0, 1, 4)",
    "source_json_array": "SELECT item_id AS idx, text AS func, (item_id % 2)::INTEGER AS target FROM benchmark",
    "source_split_ids": "SELECT DISTINCT doc_id AS idx FROM labels",
    "source_template_catalogue": f"SELECT exploit_id, vuln_type, 'c' AS language, '' AS payload_template, harness_template, '' AS expected_behavior, '' AS source_cve, tags, '' AS compilation_cmd, timeout_sec, '' AS expected_signals, '' AS description FROM ({_TEMPLATES})",
    "source_catalogue_jsonl": _ENTRIES,
    "source_catalogue_union": f"SELECT vuln_type, count(*) AS n, min(exploit_id) AS first_id FROM (SELECT exploit_id, vuln_type FROM ({_TEMPLATES}) UNION ALL SELECT exploit_id, vuln_type FROM ({_ENTRIES})) GROUP BY 1",
    "source_files": "SELECT text || chr(10) AS code FROM benchmark UNION ALL SELECT 'int inline_sample;'",
    "source_word_vectors": "SELECT 'word' || vec_id AS word, len(embedding)::INTEGER AS dims, embedding[1]::DOUBLE AS e0, embedding[64]::DOUBLE AS e63 FROM embeddings WHERE vec_id % 3 < 2",
    "index_save_load": f"SELECT vec_id, label, {_PARTS} FROM embeddings",
    "index_append": f"{_GROWN} (SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE vec_id % 10 = 0) GROUP BY 1",
    "index_stream_append": f"{_GROWN} embeddings GROUP BY 1",
    "index_rebuild": "SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids FROM (SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE label >= 5) GROUP BY 1",
    "exec_log_parse": f"WITH {_RAW} SELECT event_id, coalesce(try_cast(regexp_extract(t, 'EXIT_CODE=(\\d+)', 1) AS INTEGER), returncode) AS exit_code, coalesce(stdout, '') AS stdout, coalesce(stderr, '') || CASE WHEN section <> '' THEN chr(10) || section ELSE '' END AS stderr, compiled, section[1:10000] AS valgrind_output, CASE WHEN compiled THEN '' ELSE t[1:10000] END AS compilation_error FROM s",
    "exec_log_cut": f"SELECT doc_id, substring(text, 1, {OUTPUT_CHARS}) AS stdout, substring(source, 1, {OUTPUT_CHARS}) AS stderr FROM documents",
    "sink_splits": "SELECT DISTINCT doc_id, text, 'train' AS split FROM documents JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT DISTINCT doc_id, text, 'test' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1",
    "sink_predictions": f"SELECT sample_id AS idx, (hybrid_score > 0.5::DOUBLE)::INTEGER AS prediction FROM {fx.PREDICTIONS_SQL}",
    "sink_results": f"SELECT sample_id AS \"index\", (sample_id % 2)::INTEGER AS label, hybrid_score, 'SAFE' AS verdict FROM {fx.PREDICTIONS_SQL}",
    "sink_metrics": f"""WITH p AS (SELECT hybrid_score > 0.5::DOUBLE AS p, hybrid_score > 0.3::DOUBLE AS b, sample_id % 2 = 1 AS y, sample_id % 4 AS tried,
      CASE WHEN sample_id % 3 = 0 THEN sample_id % 4 ELSE 0 END AS confirmed, (sample_id * 13 % 97)::DOUBLE / 8::DOUBLE AS seconds FROM {fx.PREDICTIONS_SQL}),
    c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (NOT p AND NOT y) AS tn, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn,
      count(*) FILTER (b AND NOT y) AS fb, sum(confirmed)::DOUBLE / sum(tried)::DOUBLE AS rate, avg(seconds) AS mean, median(seconds) AS middle FROM p)
    SELECT 'full' AS mode, tp + tn + fp + fn AS total, (tp + tn)::DOUBLE / (tp + tn + fp + fn)::DOUBLE AS accuracy, tp::DOUBLE / (tp + fp)::DOUBLE AS precision, tp::DOUBLE / (tp + fn)::DOUBLE AS recall,
      2::DOUBLE * (tp::DOUBLE / (tp + fp)::DOUBLE) * (tp::DOUBLE / (tp + fn)::DOUBLE) / (tp::DOUBLE / (tp + fp)::DOUBLE + tp::DOUBLE / (tp + fn)::DOUBLE) AS f1,
      tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, (fb - fp)::DOUBLE / fb::DOUBLE AS fp_reduction,
      rate AS exploitation_rate, mean AS avg_time, middle AS median_time FROM c""",
    "report_json": f"WITH {_RESULTS} SELECT sample_id, verdict, 'buffer_overflow' AS vuln_type, 'CWE-121' AS cwe_id, 'asan' AS sanitizer_source, text[1:20] AS taint_context, CASE WHEN reviewed THEN 'true_positive' END AS triage_verdict, CASE WHEN reviewed THEN coalesce(text, '') END AS triage_reasoning, confidence, hybrid_score, tried::DOUBLE AS exploits_tried, total_time, CASE WHEN reviewed THEN tc END AS triage_confidence, CASE WHEN tried > 0 THEN 'x' || sample_id END AS second_exploit, reviewed FROM r",
    "report_text": f"""WITH {_RESULTS} SELECT sample_id, '{_RULE}' || {_N} || 'VULNERABILITY SCAN REPORT' || {_N} || '{_RULE}' || {_N} || {_N} || '  Verdict:      ' || CASE verdict WHEN 'CONFIRMED' THEN '[!!] ' WHEN 'SUGGESTIVE' THEN '[!] ' WHEN 'NEUTRAL' THEN '[?] ' ELSE '[OK] ' END || verdict || {_N}
  || '  Confidence:   ' || {_PERCENT("confidence")} || {_N} || '  Vuln Type:    buffer_overflow (' || {_PERCENT("type_conf")} || ')' || {_N} || format('  Total Time:   {{:.2f}}s', total_time) || {_N}
  || {_N} || '  Detection Scores:' || {_N} || format('    Classifier:   {{:.4f}}', cls_prob) || {_N} || format('    FAISS:        {{:.4f}}', faiss_score) || {_N} || format('    Hybrid:       {{:.4f}}', hybrid_score) || {_N}
  || CASE WHEN tried > 0 THEN {_N} || '  Exploit Verification:' || {_N} || format('    Tried:      {{}}', tried) || {_N} || format('    Confirmed:  {{}}', confirmed) || {_N} || {_detail(1)} || {_N} || {_detail(2)} || {_N} ELSE '' END
  || CASE WHEN reviewed THEN {_N} || '  Triage Head (LLM):' || {_N} || '    Verdict:    true_positive' || {_N} || '    Confidence: ' || {_PERCENT("tc")} || {_N}
    || CASE WHEN coalesce(text, '') <> '' THEN '    Reasoning:  ' || text[1:{report.REASONING_CHARS}] || CASE WHEN length(text) > {report.REASONING_CHARS} THEN '...' ELSE '' END || {_N} ELSE '' END ELSE '' END
  || {_N} || '{_RULE}' AS report FROM r""",
    "report_summary": f"""WITH {_RESULTS} SELECT format('Batch Summary ({{}} samples):', count(*)) || {_N} || """
    + f" || {_N} || ".join(f"format('{f'  {v}:'.ljust(14)}{{}} ({{:.1f}}%)', count(*) FILTER (verdict = '{v}'), (count(*) FILTER (verdict = '{v}'))::DOUBLE / count(*) * 100)" for v in ("CONFIRMED", "SUGGESTIVE", "NEUTRAL", "SAFE"))
    + f" || {_N} || format('  Avg time:   {{:.2f}}s', avg(total_time)) AS summary FROM r",
}
