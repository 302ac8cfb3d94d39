"""Queries that train or apply a model. The network's weights follow a rule, so that SQL can state its layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, model, network
from ..sources import readers
from . import fixtures as fx
from .file_queries import template_folder
from .lineage import place

VOCABULARY, WIDTH, EMBED, ORDER = 512, 4, 3, 3
SHAPES = {
    "table": (VOCABULARY, WIDTH), "layer0": (WIDTH, WIDTH), "layer1": (WIDTH, WIDTH), "attention": (WIDTH, 1),
    "value": (WIDTH, WIDTH), "dense": (WIDTH, WIDTH), "out": (WIDTH, 1), "embed0": (WIDTH, WIDTH), "embed1": (WIDTH, EMBED),
}


#: A gated network with a low-rank correction whose probability comes from convolutions; kernels with their width first.
CONV_SHAPES = {
    "table": (VOCABULARY, WIDTH), "encode": (WIDTH, WIDTH), "encode_down": (WIDTH, 2), "encode_up": (2, WIDTH), **dict.fromkeys(network.GATES, (WIDTH, WIDTH)),
    "conv0": (3, WIDTH, WIDTH), "conv1": (1, WIDTH, WIDTH), "score": (WIDTH, 1), "both_conv0": (3, 2 * WIDTH, 2 * WIDTH), "both_conv1": (1, 2 * WIDTH, 2 * WIDTH),
    "both_score": (2 * WIDTH, 1), "attention": (WIDTH, 1), "value": (WIDTH, WIDTH), "embed0": (WIDTH, WIDTH), "embed1": (WIDTH, EMBED),
}
CONV_NET = model.Network("gated", steps=1, residual=False, conv=True, scale=0.5)
LEARNED = network.Training(epochs=8, steps=8, batch=64, rate=0.02, contrast=0.1)
LEARNED_NET = model.Network(how="concat")
LEARNED_VOCABULARY, LEARNED_WIDTH = 4096, 16


def weights_by_rule(shapes: dict[str, tuple[int, ...]] = SHAPES) -> dict[str, np.ndarray]:
    """Stand-in weights of the graph network, in thirty-seconds; real ones are an input or trained."""
    rule = lambda i, n, m: ((np.arange(n)[:, None] * 7 + np.arange(m) * 13 + i * 5) % 17 - 8) / 32
    return {name: rule(i, int(np.prod(s[:-1])), s[-1]).reshape(s) for i, (name, s) in enumerate(shapes.items())}


def token_ids(code: Column, vocabulary: int = VOCABULARY) -> Column:
    """Tokens by the first digits of their MD5."""
    return F.transform(text.tokens(code), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"), F.lit(vocabulary)))


def _rated(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = fx.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("target"))
    return docs.join(labels, "doc_id")


def _trained(spark, sf_dir):
    """A model of one part of the rated documents, chosen on a second; the third is for scoring."""
    rated = _rated(spark, sf_dir)
    chosen, _ = model.train_best(rated.filter("doc_id % 5 > 1"), rated.filter("doc_id % 5 = 1"), "text")
    return chosen, rated.filter("doc_id % 5 = 0")


def model_baseline(spark, sf_dir):
    """Rated documents scored by a logistic regression trained and chosen on others."""
    chosen, held_out = _trained(spark, sf_dir)
    return model.score_baseline(chosen, held_out, "text").select("doc_id", "target", "cls_prob")


def model_checkpoint(spark, sf_dir):
    """Whether the model that was saved and loaded gives each document the probability of the one in memory."""
    chosen, held_out = _trained(spark, sf_dir)
    path = place(spark, "checkpoint")
    model.save(chosen, path)
    mine = model.score_baseline(chosen, held_out, "text").select("doc_id", F.col("cls_prob").alias("p"))
    again = model.score_baseline(model.load(path), held_out, "text").select("doc_id", "cls_prob")
    return mine.join(again, "doc_id").select("doc_id", (F.col("p") == F.col("cls_prob")).alias("same"), F.col("p").between(0, 1).alias("in_range"))


def _rounded(scored):
    return [F.round(F.get("embedding", i), 6).alias(f"e{i}") for i in range(EMBED)]


def model_graph_scores(spark, sf_dir):
    """Probability and embedding of every document's token graph."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))
    scored = model.graph_scores(docs, "doc_id", "ids", weights_by_rule())
    return scored.select(F.col("id").alias("doc_id"), F.round("cls_prob", 6).alias("cls_prob"), *_rounded(scored))


def model_conv_scores(spark, sf_dir):
    """Probability of every document by a gated step and convolutions over its nodes."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))
    scored = model.graph_scores(docs, "doc_id", "ids", weights_by_rule(CONV_SHAPES), net=CONV_NET)
    return scored.select(F.col("id").alias("doc_id"), F.round("cls_prob", 6).alias("cls_prob"))


def model_gradients(spark, sf_dir):
    """Mean log loss of all rated documents under the given weights, and its gradients of the two last layers."""
    rated = _rated(spark, sf_dir).select(token_ids(F.col("text")).alias("ids"), "target")
    how = network.Training(contrast=0.0)
    _, loss, grads = network.mean_gradient(network.batches(rated, "ids", "target", how), weights_by_rule(), model.Network(), how)
    rows = [("loss", 0, 0, float(loss))] + [(name, *at, float(x)) for name in ("dense", "out") for at, x in np.ndenumerate(grads[name])]
    made = spark.createDataFrame(rows, "name string, i int, j int, value double")
    return made.withColumn("value", F.round("value", 6) + 0.0)


def model_network(spark, sf_dir):
    """Rated documents scored by a graph network that was trained on others, its best epoch chosen on a third part."""
    rated = _rated(spark, sf_dir).select("doc_id", token_ids(F.col("text"), LEARNED_VOCABULARY).alias("ids"), "target")
    start = network.fresh_weights(LEARNED_VOCABULARY, LEARNED_WIDTH, LEARNED_WIDTH, LEARNED_NET)
    best = network.train(rated.filter("doc_id % 5 > 1"), rated.filter("doc_id % 5 = 1"), place(spark, "network"), start=start, net=LEARNED_NET, how=LEARNED)
    held_out = rated.filter("doc_id % 5 = 0").withColumn("id", F.struct("doc_id", "target"))
    return model.graph_scores(held_out, "id", "ids", best.weights, net=LEARNED_NET).select("id.*", "cls_prob")


def model_catalogue_vectors(spark, sf_dir):
    """A template catalogue re-encoded by the network."""
    catalogue = readers.template_catalogue(spark, template_folder(spark, sf_dir))
    encoded = model.encode_catalogue(catalogue, token_ids, weights_by_rule())
    return encoded.select("exploit_id", *_rounded(encoded))


def model_chebyshev(spark, sf_dir):
    """Polynomials of complete graphs of two to six nodes, one a document."""
    n = (F.col("doc_id") % 5).cast("int") + 2
    every = F.sequence(F.lit(0), n - 1)
    pairs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), n.alias("n"), F.explode(every).alias("src")).withColumn("dst", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    edges = pairs.filter("src <> dst").select("id", "src", "dst", F.lit(1.0).alias("w"))
    terms = model.chebyshev_terms(graph.normalized(edges), ORDER)
    whole = pairs.select("id", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"), F.col("src").alias("i"), F.col("dst").alias("j"))
    filled = whole.join(terms, ["id", "k", "i", "j"], "left")  # with the zeros that the terms leave out
    return filled.select("id", "k", "i", "j", (F.round(F.coalesce("value", F.lit(0.0)), 6) + 0.0).alias("value"))


def _valued(spark, sf_dir):
    """Token ids of every document, and a number for each."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))
    return docs.withColumn("x", F.transform("ids", lambda t: (t % 17) / F.lit(16.0)))


def model_chebyshev_tokens(spark, sf_dir):
    """Chebyshev terms of every document's token graph applied to node values, under the bound 2 of all its eigenvalues."""
    terms = model.token_chebyshev(_valued(spark, sf_dir), "doc_id", "ids", "x", ORDER, largest=2.0)
    return terms.select(F.col("id").alias("doc_id"), "node", *[(F.round(F.get("terms", k), 6) + 0.0).alias(f"t{k}") for k in range(1, ORDER + 1)])


def model_eigenvalues(spark, sf_dir):
    """The largest eigenvalue of the normalised Laplacian of every document's token graph."""
    return model.largest_eigenvalues(_valued(spark, sf_dir), "doc_id", "ids").select(F.col("id").alias("doc_id"), "nodes", "largest")


QUERIES = {f.__name__: f for f in (model_baseline, model_checkpoint, model_graph_scores, model_conv_scores, model_gradients, model_network, model_catalogue_vectors, model_chebyshev, model_chebyshev_tokens, model_eigenvalues)}


def _product(x: str, name: str, column: int) -> str:
    """Inner product of the list ``x`` and a column of given weights."""
    return f"list_inner_product({x}, [{', '.join(repr(float(v)) for v in weights_by_rule()[name][:, column])}]::DOUBLE[])"


def _layer(x: str, name: str) -> str:
    return "[" + ", ".join(_product(x, name, j) for j in range(SHAPES[name][1])) + "]"


def _passed(features: str) -> str:
    """Sums of a list column over edges, cut at zero; one list a node."""
    sums = ", ".join(f"greatest(sum(w * h[{j + 1}]), 0)" for j in range(WIDTH))
    return f"SELECT id, src AS node, [{sums}] AS x FROM m JOIN {features} f ON f.id = m.id AND f.node = m.dst GROUP BY 1, 2".replace("SELECT id,", "SELECT m.id,", 1)


def _edges_sql(samples: str) -> str:
    """tk: token ids; m: normalised edges of ``samples`` (id, text)."""
    return f"""tk AS (SELECT id, list_transform(regexp_extract_all(text, '\\w+|[^\\w\\s]'), lambda t: ('0x' || substring(md5(t), 1, 4))::INTEGER % {VOCABULARY}) AS k FROM {samples}),
q AS (SELECT id, k[p + 1] AS a, k[p - d + 1] AS b FROM tk, unnest(range(1, len(k))) AS x(p), (VALUES (1), (2)) AS w(d) WHERE p - d >= 0),
e AS (SELECT DISTINCT id, a AS src, b AS dst FROM q WHERE a <> b UNION SELECT DISTINCT id, b, a FROM q WHERE a <> b),
g AS (SELECT id, src, count(*)::DOUBLE AS degree FROM e GROUP BY 1, 2),
m AS (SELECT e.id, e.src, e.dst, 1 / sqrt(y.degree * z.degree) AS w FROM e JOIN g y ON y.id = e.id AND y.src = e.src JOIN g z ON z.id = e.id AND z.src = e.dst)"""


def _network_sql(samples: str) -> str:
    """id, p, v of ``samples`` (id, text): the layers as joins over edges."""
    return f"""{_edges_sql(samples)},
n AS (SELECT DISTINCT id, unnest(k) AS node FROM tk),
t0 AS (SELECT id, node, list_transform(range({WIDTH}), lambda c: ((node * 7 + c * 13) % 17 - 8)::DOUBLE / 32::DOUBLE) AS x FROM n),
h0 AS (SELECT id, node, {_layer("x", "layer0")} AS h FROM t0), p0 AS ({_passed("h0")}),
t1 AS (SELECT n.id, n.node, coalesce(x, list_transform(range({WIDTH}), lambda c: 0::DOUBLE)) AS x FROM n LEFT JOIN p0 ON p0.id = n.id AND p0.node = n.node),
h1 AS (SELECT id, node, {_layer("x", "layer1")} AS h FROM t1), p1 AS ({_passed("h1")}),
t2 AS (SELECT t1.id, t1.node, CASE WHEN p1.x IS NULL THEN t1.x ELSE [{", ".join(f"t1.x[{j + 1}] + p1.x[{j + 1}]" for j in range(WIDTH))}] END AS x FROM t1 LEFT JOIN p1 ON p1.id = t1.id AND p1.node = t1.node),
y AS (SELECT id, 1 / (1 + exp(-{_product("x", "attention", 0)})) AS s, {_layer("x", "value")} AS v FROM t2),
r AS (SELECT id, [{", ".join(f"sum(s * greatest(v[{j + 1}], 0)) * max(s * greatest(v[{j + 1}], 0))" for j in range(WIDTH))}] AS g FROM y GROUP BY 1),
d AS (SELECT id, list_transform({_layer("g", "dense")}, lambda c: tanh(c)) AS t, list_transform({_layer("g", "embed0")}, lambda c: greatest(c, 0)) AS u FROM r),
o AS (SELECT id, 1 / (1 + exp(-{_product("t", "out", 0)})) AS p, {_layer("u", "embed1")} AS v FROM d),
z AS (SELECT id, p, v, sqrt(list_inner_product(v, v)) AS l FROM o)"""


def _by(x: str, matrix: np.ndarray, more: str = "{}") -> str:
    """The row ``x`` times a matrix, each number within ``more``."""
    return "[" + ", ".join(more.format(f"list_inner_product({x}, [{', '.join(repr(float(v)) for v in column)}]::DOUBLE[])") for column in matrix.T) + "]"


def _conv_sql() -> str:
    """id, p of ``s`` (id, text): one gated step, then both branches of convolutions over lists of node rows."""
    w = weights_by_rule(CONV_SHAPES)
    zero = f"list_transform(range({WIDTH}), lambda c: 0::DOUBLE)"
    each = range(WIDTH)
    gate = lambda name: "[" + ", ".join(f"1 / (1 + exp(-({a} + {b})))" for a, b in zip(_parts(_by("a", w[name + "_in"])), _parts(_by("x", w[name + "_self"])), strict=True)) + "]"
    new = "[" + ", ".join(f"greatest({a} + {b}, 0)" for a, b in zip(_parts(_by("a", w["h_in"])), _parts(_by("q", w["h_self"])), strict=True)) + "]"

    def branch(rows: str, name: str, wide: str, narrow: str, score: str) -> str:
        n = w[wide].shape[2]
        slid = "[" + ", ".join("greatest(" + " + ".join(_parts(_by(f"{rows}[i + {k}]", w[wide][k][:, [j]]))[0] for k in range(3)) + ", 0)" for j in range(n)) + "]"
        most = lambda size: "[" + ", ".join("greatest(" + ", ".join(f"c[2 * i + {k + 1}][{j + 1}]" for k in range(size)) + ")" for j in range(n)) + "]"
        return f"""{name}1 AS (SELECT id, list_transform(range(1, len({rows}) - 1), lambda i: {slid}) AS c FROM gx),
{name}2 AS (SELECT id, list_transform(range(0, (len(c) - 3) // 2 + 1), lambda i: {most(3)}) AS c FROM {name}1),
{name}3 AS (SELECT id, list_transform(c, lambda y: {_by("y", w[narrow][0], "greatest({}, 0)")}) AS c FROM {name}2),
{name}4 AS (SELECT id, list_transform(range(0, (len(c) - 2) // 2 + 1), lambda i: {_parts(_by(most(2), w[score]))[0]}) AS c FROM {name}3)"""

    return f"""{_edges_sql("s")},
n AS (SELECT id, node, min(place) AS place FROM (SELECT id, unnest(k) AS node, generate_subscripts(k, 1) AS place FROM tk) GROUP BY 1, 2),
f AS (SELECT *, list_transform(range({WIDTH}), lambda c: ((node * 7 + c * 13) % 17 - 8)::DOUBLE / 32::DOUBLE) AS f FROM n),
x0 AS (SELECT *, {_by("f", w["encode"] + CONV_NET.scale * w["encode_down"] @ w["encode_up"])} AS x FROM f),
mm AS (SELECT m.id, m.src AS node, [{", ".join(f"sum(w * x[{j + 1}])" for j in each)}] AS a FROM m JOIN x0 ON x0.id = m.id AND x0.node = m.dst GROUP BY 1, 2),
x1 AS (SELECT x0.*, coalesce(a, {zero}) AS a FROM x0 LEFT JOIN mm USING (id, node)),
x2 AS (SELECT *, {gate("z")} AS z, {gate("r")} AS r FROM x1),
x3 AS (SELECT *, [{", ".join(f"r[{j + 1}] * x[{j + 1}]" for j in each)}] AS q FROM x2),
x4 AS (SELECT *, {new} AS h FROM x3),
x5 AS (SELECT id, place, f, [{", ".join(f"h[{j + 1}] * z[{j + 1}] + x[{j + 1}] * (1 - z[{j + 1}])" for j in each)}] AS x FROM x4),
gx AS (SELECT id, list(x ORDER BY place) AS alone, list(list_concat(x, f) ORDER BY place) AS beside FROM x5 GROUP BY 1 HAVING count(*) >= 7),
{branch("alone", "a", "conv0", "conv1", "score")},
{branch("beside", "b", "both_conv0", "both_conv1", "both_score")},
z AS (SELECT id, 1 / (1 + exp(-list_inner_product(a4.c, b4.c) / len(a4.c))) AS p FROM a4 JOIN b4 USING (id))"""


def _chebyshev_sql() -> str:
    """t1 = -A x, then 2 (-A) t_k - t_{k-1}, as joins over edges."""
    made = [f"x{k} AS (SELECT n.id, n.node, -{min(k, 2)} * coalesce(sum(w * x{k - 1}.x), 0) - {'any_value(b.x)' if k > 1 else '0'} AS x FROM n LEFT JOIN m ON m.id = n.id AND m.src = n.node LEFT JOIN x{k - 1} ON x{k - 1}.id = m.id AND x{k - 1}.node = m.dst {f'JOIN x{k - 2} b ON b.id = n.id AND b.node = n.node' if k > 1 else ''} GROUP BY 1, 2)" for k in range(1, ORDER + 1)]
    listed = ", ".join(f"round(x{k}.x, 6) + 0.0 AS t{k}" for k in range(1, ORDER + 1))
    joined = " ".join(f"JOIN x{k} USING (id, node)" for k in range(2, ORDER + 1))
    return f"""WITH s AS (SELECT doc_id AS id, text FROM documents), {_edges_sql("s")}, n AS (SELECT DISTINCT id, unnest(k) AS node FROM tk),
x0 AS (SELECT id, node, (node % 17) / 16.0::DOUBLE AS x FROM n), {", ".join(made)} SELECT id AS doc_id, node, {listed} FROM x1 {joined}"""


def _parts(listed: str) -> list[str]:
    """The numbers of a list that ``_by`` wrote."""
    return [x + "::DOUBLE[])" for x in listed[1:-1].removesuffix("::DOUBLE[])").split("::DOUBLE[]), ")]


def _gradient_sql() -> str:
    """Loss and gradients of the last layers in closed form."""
    out = ", ".join(repr(float(v)) for v in weights_by_rule()["out"][:, 0])
    return f"""WITH v AS (SELECT doc_id AS id, text, target FROM documents JOIN (SELECT doc_id, min(quality) AS target FROM labels GROUP BY 1) AS l USING (doc_id) WHERE target IS NOT NULL),
s AS (SELECT id, text FROM v), {_network_sql('s')},
b AS (SELECT coalesce(p, 0.5) AS p, target, g, t, (SELECT count(*) FROM v) AS n FROM v LEFT JOIN o USING (id) LEFT JOIN d USING (id) LEFT JOIN r USING (id)),
c AS (SELECT *, (-target / (p + 1e-10) + (1 - target) / (1 - p + 1e-10)) * p * (1 - p) / n AS ds, [{out}]::DOUBLE[] AS w FROM b),
u AS (SELECT 'loss' AS name, 0 AS i, 0 AS j, -sum(target * ln(p + 1e-10) + (1 - target) * ln(1 - p + 1e-10)) / any_value(n) AS value FROM c HAVING count(*) > 0
UNION ALL SELECT 'out', i, 0, sum(ds * t[i + 1]) FROM c, unnest(range({WIDTH})) AS a(i) GROUP BY i
UNION ALL SELECT 'dense', i, j, sum(g[i + 1] * ds * w[j + 1] * (1 - t[j + 1] * t[j + 1])) FROM c, unnest(range({WIDTH})) AS a(i), unnest(range({WIDTH})) AS e(j) GROUP BY i, j)
SELECT name, i::INTEGER AS i, j::INTEGER AS j, round(value, 6) + 0.0 AS value FROM u"""


_PARTS = ", ".join(f"coalesce(round(CASE WHEN l > 0 THEN v[{i + 1}] / l ELSE v[{i + 1}] END, 6), 0) AS e{i}" for i in range(EMBED))
SQL = {
    "model_checkpoint": "SELECT DISTINCT doc_id, true AS same, true AS in_range FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 = 0",
    "model_graph_scores": f"WITH s AS (SELECT doc_id AS id, text FROM documents), {_network_sql('s')} SELECT s.id AS doc_id, coalesce(round(p, 6), 0.5) AS cls_prob, {_PARTS} FROM s LEFT JOIN z USING (id)",
    "model_conv_scores": f"WITH s AS (SELECT doc_id AS id, text FROM documents), {_conv_sql()} SELECT s.id AS doc_id, coalesce(round(p, 6), 0.5) AS cls_prob FROM s LEFT JOIN z USING (id)",
    "model_gradients": _gradient_sql(),
    "model_catalogue_vectors": f"WITH s AS (SELECT 't' || item_id AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark), {_network_sql('s')} SELECT s.id AS exploit_id, {_PARTS} FROM s LEFT JOIN z USING (id) WHERE s.text <> ''",
    "model_chebyshev_tokens": _chebyshev_sql(),
    "model_chebyshev": f"SELECT doc_id AS id, k::INTEGER AS k, i::INTEGER AS i, j::INTEGER AS j, round((i = j)::INTEGER - CASE WHEN k % 2 = 1 THEN 2::DOUBLE / (doc_id % 5 + 2) ELSE 0 END, 6) AS value FROM documents, unnest(range({ORDER + 1})) AS a(k), unnest(range(doc_id % 5 + 2)) AS b(i), unnest(range(doc_id % 5 + 2)) AS c(j)",
}
