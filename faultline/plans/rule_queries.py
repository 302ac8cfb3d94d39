"""Queries of single rules: validity, caps, masks, listings, prompts, responses and stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence, graph, selection, taint, triage, vector_search, verdict
from . import fixtures as fx
from .table_queries import hop_values

MOST, HEAD = 3, 20

PYTHON_DDL = "before string, after string"
#: Sources and what is left of them; the text of a row takes the place of @.
PYTHONS = [
    ("# about @\ndef f(a):\n    '''says @'''\n\n    return a  # @\n", "def f(a):\n    return a  "),
    ("x = '# @ stays'\ny = 2\n", "x = '# @ stays'\ny = 2"),
    ('class C:\n    """Of @."""\n    n = 1\n', "class C:\n    n = 1"),
    ("def broken(:\n  # @\n", "def broken(:\n  # @\n"),
    ("\n\nz = [1,  # @\n     2]\n", "z = [1,  \n     2]"),
]


def text_python_comments(spark, sf_dir):
    rows = fx.dealt(spark, fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", PYTHONS, PYTHON_DDL)
    source = F.replace("before", F.lit("@"), F.col("n_chars").cast("string"))
    return rows.select("doc_id", text.strip_python_comments(source).alias("bare"))


def text_valid(spark, sf_dir):
    """Whether code and payload hold anything; a null holds nothing."""
    blank = F.when(F.col("doc_id") % 4 == 0, F.lit(" \n\t")).otherwise(F.col("source"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.is_valid(F.col("text"), blank), F.lit(False)).alias("valid"))


def text_triage_prompt(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").withColumn("score", (F.pmod("n_chars", F.lit(16)) / 16.0).cast("double"))
    cwe = F.when(F.col("doc_id") % 2 == 0, F.lit("CWE-121")).otherwise("")
    context = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("")
    asked = text.triage_prompt(F.col("text"), F.lit("buffer_overflow"), cwe, F.col("score"), context)
    return docs.select("doc_id", F.md5(asked).alias("prompt_md5"), F.length(asked).alias("n_chars"), F.md5(text.review_prompt(F.col("text"), context)).alias("review_md5"))


def selection_mask(spark, sf_dir):
    docs, labels = fx.table(spark, sf_dir, "documents").select("doc_id"), fx.table(spark, sf_dir, "labels")
    return selection.mask(docs, labels.filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", "selected")


def selection_first_of_key(spark, sf_dir):
    """The first event of each user and type, at most so many a user."""
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value"))
    return selection.dedup_by_key(events, ["event_type"], [F.col("event_id")], MOST, ["user_id"])


def evidence_cap(spark, sf_dir):
    """At most so many runs of a sample, in order."""
    return evidence.cap(fx.logs(spark, sf_dir).select("run_id", "sample_id", "ord"), "sample_id", [F.col("ord")], HEAD)


def vec_types(spark, sf_dir):
    index = fx.table(spark, sf_dir, "embeddings").withColumn("vuln_type", F.when(F.col("label") > 0, F.concat(F.lit("type_"), F.col("label").cast("string"))))
    one = vector_search.of_type(index, "type_3").groupBy("vuln_type").agg(F.count(F.lit(1)).alias("n"))
    return vector_search.types(index).join(one, "vuln_type", "left")


def taint_dangerous(spark, sf_dir):
    return taint.dangerous_functions(taint.paths(fx.codes(spark, sf_dir))).select("sample_id", F.array_join("functions", ",").alias("functions"))


def triage_adapter_json(spark, sf_dir):
    reviews = fx.reviews(spark, sf_dir)
    return reviews.select("sample_id", triage.adapter_json(F.col("response")).alias("json"), triage.code_block(F.col("response")).alias("code"))


def verdict_dry_run(spark, sf_dir):
    return verdict.dry_run(fx.kinds(spark, sf_dir))


def graph_pool_sum(spark, sf_dir):
    return graph.pool(hop_values(spark, sf_dir), "sum").select("id", F.round("graph", 5).alias("graph"))


def graph_pool_concat(spark, sf_dir):
    both = graph.pool(hop_values(spark, sf_dir), "concat")
    return both.select("id", F.round(F.get("graph", 0), 5).alias("total"), F.round(F.get("graph", 1), 6).alias("most"))


def graph_positions(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    edges = graph.position_edges(docs, "doc_id", "tokens")
    return edges.groupBy("id", "src").agg(F.sum("w").alias("degree"), F.min("dst").alias("low"), F.max("dst").alias("high"))


def graph_normalized_edges(spark, sf_dir):
    """Edges of an edge table by joins: users who did the same kind of thing in the same hour of the day, weighted."""
    events = fx.table(spark, sf_dir, "events")
    seen = events.groupBy((F.hour("ts")).cast("long").alias("id"), F.col("event_type").alias("src"), (F.col("user_id") % 7).cast("string").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    both = seen.unionByName(seen.select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    normal = graph.normalized(both)
    features = both.select("id", F.col("src").alias("node")).distinct().withColumn("x", F.length("node").cast("double") - 4)
    return graph.hop(normal, features).select("id", "node", F.round("x", 6).alias("x"))


QUERIES = {
    f.__name__: f
    for f in (
        text_python_comments, text_valid, text_triage_prompt, selection_mask, selection_first_of_key, evidence_cap, vec_types,
        taint_dangerous, triage_adapter_json, verdict_dry_run, graph_pool_sum, graph_pool_concat, graph_positions,
        graph_normalized_edges,
    )
}

_LISTING = "array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: format('  {:4d}  {}', i, l)), chr(10))"
_CONTEXT = "CASE WHEN doc_id % 3 = 0 AND coalesce(source, '') <> '' THEN '### Taint context' || chr(10) || source ELSE '### Taint context' || chr(10) || 'None was found; judge by the code alone.' END"
_ANSWER = "'### Answer' || chr(10) || 'One JSON object: \"verdict\" (true_positive, false_positive or uncertain), \"confidence\" from 0 to 1, \"reasoning\".'"
_ASKED = f"concat_ws(chr(10) || chr(10), {_CONTEXT}, '### Code' || chr(10) || {_LISTING}, {_ANSWER})"
_PROMPT = f"format('### Detection\nType: buffer_overflow\nWeakness: {{}}\nScore: {{:.4f}}', CASE WHEN doc_id % 2 = 0 THEN 'CWE-121' ELSE 'N/A' END, (n_chars % 16)::DOUBLE / 16::DOUBLE) || chr(10) || chr(10) || {_ASKED}"
_SEEN = """s AS (SELECT hour(ts)::BIGINT AS id, event_type AS src, (user_id % 7)::VARCHAR AS dst, count(*)::DOUBLE AS w FROM events GROUP BY 1, 2, 3),
b AS (SELECT * FROM s UNION ALL SELECT id, dst, src, w FROM s), g AS (SELECT id, src, sum(w) AS degree FROM b GROUP BY 1, 2)"""
_FENCED, _NESTED = r"(?s)```json\s*\n(.*?)```", r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
_BLOCK = r"(?s)```(?:c|cpp)?\s*\n(.*?)```"
_TOKENS = r"regexp_extract_all(text, '\w+|[^\w\s]')"


def sql(hop: str, paths: str) -> dict[str, str]:
    """The same in SQL; ``hop`` and ``paths`` are the prefixes that define h (id, node, x) and f (paths)."""
    return {
        "text_python_comments": f"SELECT doc_id, replace(after, '@', n_chars::VARCHAR) AS bare FROM {fx.dealt_sql('documents', 'doc_id', PYTHONS, PYTHON_DDL)}",
        "text_valid": r"SELECT doc_id, coalesce(regexp_matches(text, '\S') AND doc_id % 4 <> 0 AND regexp_matches(source, '\S'), false) AS valid FROM documents",
        "text_triage_prompt": f"SELECT doc_id, md5({_PROMPT}) AS prompt_md5, length({_PROMPT})::INTEGER AS n_chars, md5({_ASKED}) AS review_md5 FROM documents",
        "selection_mask": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS selected FROM documents",
        "selection_first_of_key": f"SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1) WHERE r <= {MOST}",
        "evidence_cap": f"SELECT run_id, sample_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord) AS r FROM {fx.LOGS_SQL}) WHERE r <= {HEAD}",
        "vec_types": "SELECT 'type_' || label AS vuln_type, CASE WHEN label = 3 THEN count(*) END AS n FROM embeddings WHERE label > 0 GROUP BY label",
        "taint_dangerous": f"{paths} SELECT sample_id, string_agg(DISTINCT sink_func, ',' ORDER BY sink_func) AS functions FROM f WHERE path_no <= 20 GROUP BY 1",
        "triage_adapter_json": f"""WITH x AS (SELECT sample_id, response, regexp_extract(response, '{_FENCED}', 1) AS a, regexp_extract(response, '{_NESTED}') AS b, trim(regexp_extract(response, '{_BLOCK}', 1), ' ' || chr(10)) AS c FROM {fx.REVIEWS_SQL})
          SELECT sample_id, CASE WHEN a <> '' AND json_valid(a) THEN a WHEN b <> '' AND json_valid(b) THEN b END AS json, CASE WHEN contains(c, 'main(') OR contains(c, 'int main') THEN c END AS code FROM x""",
        "verdict_dry_run": f"SELECT *, 'NEUTRAL' AS evidence_level, 'dry run' AS reason, 0::DOUBLE AS confidence, 'uncertain' AS triage_verdict, 0.5::DOUBLE AS triage_confidence FROM {fx.KINDS_SQL}",
        "graph_pool_sum": f"{hop} SELECT id, round(sum(x) + max(x), 5) AS graph FROM h GROUP BY 1",
        "graph_pool_concat": f"{hop} SELECT id, round(sum(x), 5) AS total, round(max(x), 6) AS most FROM h GROUP BY 1",
        "graph_positions": f"WITH t AS (SELECT doc_id AS id, len({_TOKENS}) AS n FROM documents), e AS (SELECT id, p, p + o AS q FROM t, unnest(range(n)) AS x(p), (VALUES (-2), (-1), (1), (2)) AS w(o) WHERE p + o BETWEEN 0 AND n - 1) SELECT id, p::INTEGER AS src, count(*)::DOUBLE AS degree, min(q)::INTEGER AS low, max(q)::INTEGER AS high FROM e GROUP BY 1, 2",
        "graph_normalized_edges": f"WITH {_SEEN} SELECT b.id, b.src AS node, round(greatest(sum(w / sqrt(y.degree * z.degree) * (length(b.dst) - 4)), 0), 6) AS x FROM b JOIN g y ON y.id = b.id AND y.src = b.src JOIN g z ON z.id = b.id AND z.src = b.dst GROUP BY 1, 2",
    }
