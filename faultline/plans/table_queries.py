"""Queries over documents, labels, pages, conversations and events: evaluation, text, graphs, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, evidence, graph, selection
from . import fixtures as fx

LONG_TEXT, BLOCK, SAMPLE_SHARE, SEED = 1500, 400, 0.2, 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- evaluation: rated documents, with length as the score --------------------------------------------------


def rated(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), "toxic", F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") > LONG_TEXT).cast("int").alias("prediction"),
        ((F.col("n_chars") > LONG_TEXT) & (F.col("toxic") == 0)).cast("int").alias("after"),
        (F.pmod("n_chars", F.lit(1000)) / 1000.0).cast("double").alias("prob"),
        (F.col("n_chars") / 1000.0).cast("double").alias("seconds"),
        F.when(F.col("n_chars") > 4000, "CONFIRMED").when(F.col("n_chars") > 2000, "SUGGESTIVE").when(F.col("n_chars") > 500, "NEUTRAL").otherwise("SAFE").alias("verdict"),
    )


def eval_confusion(spark, sf_dir):
    return evaluation.confusion(rated(spark, sf_dir))


def eval_prf(spark, sf_dir):
    return evaluation.rates(evaluation.confusion(rated(spark, sf_dir)))


def eval_auc(spark, sf_dir):
    return evaluation.roc_auc(rated(spark, sf_dir))


def eval_logloss(spark, sf_dir):
    return evaluation.log_loss(rated(spark, sf_dir)).select(F.round("log_loss", 6).alias("log_loss"))


def eval_logloss_batches(spark, sf_dir):
    batch = (F.col("doc_id") / 64).cast("long")
    return evaluation.log_loss(rated(spark, sf_dir), batch=batch).select(F.round("log_loss", 6).alias("log_loss"))


def eval_label_dist(spark, sf_dir):
    return evaluation.histogram(rated(spark, sf_dir), "label")


def eval_latency(spark, sf_dir):
    return evaluation.time_stats(rated(spark, sf_dir), "seconds").select(*[F.round(c, 6).alias(c) for c in ("avg_time", "median_time", "min_time", "max_time", "total_time")])


def eval_fp_reduction(spark, sf_dir):
    return evaluation.fp_reduction(rated(spark, sf_dir), "prediction", "after")


def report_verdict_rollup(spark, sf_dir):
    return evaluation.verdict_rollup(rated(spark, sf_dir), "verdict", "seconds").withColumn("avg_time", F.round("avg_time", 6))


def report_level_histogram(spark, sf_dir):
    return evaluation.histogram(rated(spark, sf_dir), "verdict")


# ---- text ---------------------------------------------------------------------------------------------------


def text_squeeze(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.squeeze(F.col("text")).alias("squeezed"))


def text_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def text_framed_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.framed(text.tokens(F.col("text")), BLOCK), " ").alias("framed"))


def text_snippet(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.snippet(text.tokens(F.col("text"))).alias("snippet"))


def text_clean_words(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.clean_words(F.col("text")).alias("cleaned"))


def text_dedup_md5(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return selection.dedup_by_content(docs, "text", "doc_id").select("doc_id", "source", "n_chars")


def text_sample(spark, sf_dir):
    return selection.sample(_table(spark, sf_dir, "documents").select("doc_id", "source"), SAMPLE_SHARE, "doc_id", SEED)


def text_cache_key(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.cache_key(F.col("text"), F.col("lang"), F.col("source")).alias("cache_key"))


def text_call_sites(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(text.call_names(F.col("html"))).alias("name")).groupBy("page_id", "name").agg(F.count(F.lit(1)).alias("n"))


def text_line_numbers(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.numbered(F.col("text")).alias("listing"))


def text_function_name(spark, sf_dir):
    return fx.codes(spark, sf_dir).select("sample_id", text.function_name(F.col("code")).alias("name"), text.defines_main(F.col("code")).alias("has_main"))


def text_strip_comments(spark, sf_dir):
    return fx.codes(spark, sf_dir).select("sample_id", text.strip_comments(F.col("code")).alias("bare"))


# ---- graphs -------------------------------------------------------------------------------------------------


def _tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


def graph_edges(spark, sf_dir):
    return graph.token_edges(_tokens(spark, sf_dir), "doc_id", "tokens").select("id", "src", "dst", "w")


def graph_edge_weights(spark, sf_dir):
    return graph.token_edges(_tokens(spark, sf_dir), "doc_id", "tokens").select("id", "src", "dst", F.col("windows").alias("w"))


def graph_degree(spark, sf_dir):
    return graph.token_nodes(_tokens(spark, sf_dir), "doc_id", "tokens").select("id", F.col("node").alias("src"), "degree")


def graph_norm_adj(spark, sf_dir):
    return graph.token_edges(_tokens(spark, sf_dir), "doc_id", "tokens").select("id", "src", "dst", F.col("norm").alias("w"))


def hop_values(spark, sf_dir):
    docs = _tokens(spark, sf_dir).withColumn("values", F.transform("tokens", lambda t: F.length(t).cast("double") - 3.0))
    return graph.token_hop(docs, "doc_id", "tokens", "values")


def graph_hop(spark, sf_dir):
    return hop_values(spark, sf_dir).select("id", "node", F.round("x", 6).alias("x"))


def graph_pool(spark, sf_dir):
    return graph.pool(hop_values(spark, sf_dir), "mul").select("id", F.round("graph", 5).alias("graph"))


# ---- selection and events -----------------------------------------------------------------------------------


def split_assign(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = _table(spark, sf_dir, "labels")
    splits = {"train": labels.filter("quality = 1").select("doc_id"), "valid": labels.filter("quality = 0").select("doc_id")}
    return selection.assign_split(docs, splits, "doc_id")


def replay_mix(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    mixed = selection.replay_mix(docs.filter("lang <> 'en'"), docs.filter("lang = 'en'"), SAMPLE_SHARE, "doc_id", SEED)
    return mixed.select("doc_id", "lang", "is_new")


def evidence_early_stop(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return evidence.until_first(events, "user_id", "event_id", F.col("event_type") == "error")


def event_props(spark, sf_dir):
    """Events counted by type and by whether their props parse as JSON."""
    v = F.try_parse_json("props")
    return _table(spark, sf_dir, "events").groupBy("event_type", v.isNotNull().alias("parses")).agg(F.count(F.lit(1)).alias("n"))


_R = f"""WITH r AS (SELECT d.doc_id, l.quality AS label, l.toxic, d.n_chars::DOUBLE AS score, (d.n_chars > {LONG_TEXT})::INTEGER AS prediction,
  (d.n_chars > {LONG_TEXT} AND l.toxic = 0)::INTEGER AS after, (d.n_chars % 1000)::DOUBLE / 1000.0::DOUBLE AS prob, d.n_chars::DOUBLE / 1000.0::DOUBLE AS seconds,
  CASE WHEN n_chars > 4000 THEN 'CONFIRMED' WHEN n_chars > 2000 THEN 'SUGGESTIVE' WHEN n_chars > 500 THEN 'NEUTRAL' ELSE 'SAFE' END AS verdict
  FROM documents d JOIN labels l USING (doc_id))"""
_CONF = "c AS (SELECT count(*) FILTER (prediction = 1 AND label = 1) AS tp, count(*) FILTER (prediction <> 1 AND label <> 1) AS tn, count(*) FILTER (prediction = 1 AND label <> 1) AS fp, count(*) FILTER (prediction <> 1 AND label = 1) AS fn FROM r)"
_LOSS = "-(label * ln(prob + 1e-10) + (1 - label) * ln(1 - prob + 1e-10))"
_TOKENS = r"regexp_extract_all(text, '\w+|[^\w\s]')"
_APART = "cleaned0"
for _tail in ("''s", "''ve", "n''t", "''re", "''d", "''ll"):
    _APART = f"replace({_APART}, '{_tail}', ' {_tail}')"
for _sign, _to in ((",", " , "), ("!", " ! "), ("(", r" \( "), (")", r" \) "), ("?", r" \? ")):
    _APART = f"replace({_APART}, '{_sign}', '{_to}')"
_PIECE = r"""(?s)//[^\n]*|/\*.*?\*/|''(?:\\.|[^\\''])*''|"(?:\\.|[^\\"])*"|[^/''"]+|."""
_HEAD = r"(?:(?:static|void|int|char|long|unsigned|short|float|double|size_t|ssize_t)\s*\*?\s+)+(\w+)\s*\("
_SKIP = "('if', 'for', 'while', 'switch', 'return', 'sizeof', 'main')"
_CODE = fx.CODES_SQL
_TOK = f"t AS (SELECT doc_id AS id, {_TOKENS} AS k FROM documents), s AS (SELECT id, k, len(k) AS n FROM t), " \
    "q AS (SELECT id, n, p, d, k[p + 1] AS a, k[p - d + 1] AS b, p - d AS o FROM s, unnest(range(1, n)) AS x(p), (VALUES (1), (2)) AS w(d) WHERE p - d >= 0)"
_E = f"WITH {_TOK}, e AS (SELECT DISTINCT id, a AS src, b AS dst FROM q WHERE a <> b UNION SELECT DISTINCT id, b, a FROM q WHERE a <> b), g AS (SELECT id, src, dst, 1.0::DOUBLE AS w FROM e), d AS (SELECT id, src, sum(w) AS degree FROM g GROUP BY 1, 2)"
_N = f"{_E}, m AS (SELECT g.id, g.src, g.dst, g.w / sqrt(x.degree * y.degree) AS w FROM g JOIN d x ON x.id = g.id AND x.src = g.src JOIN d y ON y.id = g.id AND y.src = g.dst)"
HOP_SQL = f"{_N}, h AS (SELECT id, src AS node, greatest(sum(w * (length(dst)::DOUBLE - 3.0)), 0) AS x FROM m GROUP BY 1, 2)"
_ORDER = f"md5(concat_ws(':', '{SEED}', doc_id::VARCHAR)), doc_id"

QUERIES = {
    f.__name__: f
    for f in (
        eval_confusion, eval_prf, eval_auc, eval_logloss, eval_logloss_batches, eval_label_dist, eval_latency,
        eval_fp_reduction, report_verdict_rollup, report_level_histogram, text_squeeze, text_tokens, text_framed_tokens,
        text_snippet, text_clean_words, text_dedup_md5, text_sample, text_cache_key, text_call_sites, text_line_numbers,
        text_function_name, text_strip_comments, graph_edges, graph_edge_weights, graph_degree, graph_norm_adj,
        graph_hop, graph_pool, split_assign, replay_mix, evidence_early_stop, event_props,
    )
}
SQL = {
    "eval_confusion": f"{_R}, {_CONF} SELECT * FROM c",
    "eval_prf": f"{_R}, {_CONF}, p AS (SELECT *, coalesce((tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0), 0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM c) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p",
    "eval_auc": f"{_R}, k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS m FROM r) SELECT coalesce((sum(m) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / nullif((count(*) FILTER (label = 1))::DOUBLE * count(*) FILTER (label <> 1), 0), 0) AS auc FROM k",
    "eval_logloss": f"{_R} SELECT round(avg({_LOSS}), 6) AS log_loss FROM r",
    "eval_logloss_batches": f"{_R}, b AS (SELECT doc_id // 64 AS b, avg({_LOSS}) AS m FROM r GROUP BY 1) SELECT round(avg(m), 6) AS log_loss FROM b",
    "eval_label_dist": f"{_R} SELECT label, count(*) AS n FROM r GROUP BY 1",
    "eval_latency": f"{_R} SELECT round(avg(seconds), 6) AS avg_time, round(median(seconds), 6) AS median_time, round(min(seconds), 6) AS min_time, round(max(seconds), 6) AS max_time, round(sum(seconds), 6) AS total_time FROM r",
    "eval_fp_reduction": f"{_R}, c AS (SELECT count(*) FILTER (prediction = 1 AND label <> 1) AS fp_before, count(*) FILTER (after = 1 AND label <> 1) AS fp_after FROM r) SELECT *, coalesce((fp_before - fp_after)::DOUBLE / nullif(fp_before, 0), 0) AS fp_reduction FROM c",
    "report_verdict_rollup": f"{_R} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v.lower()}" for v in evaluation.VERDICTS) + ", " + ", ".join(f"coalesce((count(*) FILTER (verdict = '{v}'))::DOUBLE / nullif(count(*), 0), 0) AS {v.lower()}_share" for v in evaluation.VERDICTS) + ", round(avg(seconds), 6) AS avg_time FROM r",
    "report_level_histogram": f"{_R} SELECT verdict, count(*) AS n FROM r GROUP BY 1",
    "text_squeeze": r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed FROM documents",
    "text_tokens": f"WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents) SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t",
    "text_framed_tokens": f"WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), f AS (SELECT doc_id, list_concat(['<s>'], t[1:{BLOCK - 2}], ['</s>']) AS f FROM t) SELECT doc_id, array_to_string(list_concat(f, list_transform(range({BLOCK} - len(f)), lambda x: '<pad>')), ' ') AS framed FROM f",
    "text_snippet": f"WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents) SELECT doc_id, substring(array_to_string(t[1:50], ' '), 1, 200) AS snippet FROM t",
    "text_clean_words": rf"WITH c AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9(),!?''`]', ' ', 'g') AS cleaned0 FROM documents) SELECT doc_id, lower(trim(regexp_replace({_APART}, '\s{{2,}}', ' ', 'g'))) AS cleaned FROM c",
    "text_dedup_md5": "SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "text_sample": f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY {_ORDER}) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor({SAMPLE_SHARE} * n)",
    "text_cache_key": "SELECT doc_id, md5(concat_ws('|', text, lang, source)) AS cache_key FROM documents",
    "text_call_sites": r"SELECT page_id, name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '\b(\w+)\s*\(', 1)) AS name FROM pages) GROUP BY 1, 2",
    "text_line_numbers": "SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: format('  {:4d}  {}', i, l)), chr(10)) AS listing FROM conversations",
    "text_function_name": rf"SELECT sample_id, CASE WHEN a <> '' AND a NOT IN {_SKIP} THEN a WHEN b <> '' AND b NOT IN {_SKIP} THEN b ELSE 'vulnerable_function' END AS name, regexp_matches(code, '\bint\s+main\s*\(') AS has_main FROM (SELECT sample_id, code, regexp_extract(code, '{_HEAD}', 1) AS a, regexp_extract(code, '(\w+)\s*\([^)]*\)\s*\{{', 1) AS b FROM {_CODE})",
    "text_strip_comments": f"SELECT sample_id, array_to_string(list_filter(string_split(array_to_string(list_transform(regexp_extract_all(code, '{_PIECE}'), lambda p: CASE WHEN starts_with(p, '//') OR starts_with(p, '/*') THEN ' ' ELSE p END), ''), chr(10)), lambda l: trim(l) <> ''), chr(10)) AS bare FROM {_CODE}",
    "graph_edges": f"{_E} SELECT * FROM g",
    "graph_edge_weights": f"WITH {_TOK}, w AS (SELECT id, a, b, CASE WHEN n <= 3 THEN 1 ELSE least(o, n - 3) - greatest(p - 2, 0) + 1 END AS c FROM q WHERE a <> b), u AS (SELECT id, a, b, c FROM w UNION ALL SELECT id, b, a, c FROM w) SELECT id, a AS src, b AS dst, sum(c)::BIGINT AS w FROM u GROUP BY 1, 2, 3",
    "graph_degree": f"{_E} SELECT * FROM d",
    "graph_norm_adj": f"{_N} SELECT * FROM m",
    "graph_hop": f"{HOP_SQL} SELECT id, node, round(x, 6) AS x FROM h",
    "graph_pool": f"{HOP_SQL} SELECT id, round(sum(x) * max(x), 5) AS graph FROM h GROUP BY 1",
    "split_assign": "SELECT d.doc_id, source, CASE WHEN quality = 1 THEN 'train' ELSE 'valid' END AS split FROM documents d JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)) l USING (doc_id)",
    "replay_mix": f"SELECT doc_id, lang, 1 AS is_new FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, lang, 0 FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {_ORDER}) AS r, count(*) OVER () AS n FROM documents WHERE lang = 'en') WHERE r <= floor({SAMPLE_SHARE} * n)",
    "evidence_early_stop": "SELECT event_id, user_id, event_type FROM (SELECT *, coalesce(sum((event_type = 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) WHERE before = 0",
    "event_props": "SELECT event_type, json_valid(props) AS parses, count(*) AS n FROM events GROUP BY 1, 2",
}
