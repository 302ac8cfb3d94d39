"""Source-to-sink paths, call edges and callers of C functions, found line by line.

Functions are found inside the row, in one pass over a running brace depth; paths are an equi-join of one sample's source
and sink hits; calls meet the functions around them by bins of lines, so rows grow with lines and not with lines times
functions; the closure over callers doubles its reach each round.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import call_names
from ..plans.lineage import cut
from ..rules import CONTROL_WORDS, DEFINITION, SINKS, SOURCES

PATH_CAP, CONTEXT_PATHS, CONTEXT_EDGES = 20, 5, 10
#: Lines of a bin in which calls meet functions.
BIN = 64


def lines_of(samples: DataFrame, id_name: str = "sample_id", code: str = "code") -> DataFrame:
    """sample_id, line (from 1), text."""
    return samples.select(F.col(id_name).alias("sample_id"), F.posexplode(F.split(code, "\n")).alias("p", "text")).select("sample_id", (F.col("p") + 1).alias("line"), "text")


def source_hits(lines: DataFrame) -> DataFrame:
    """sample_id, line, source_func, source_ord: names of input that a line mentions, comments included."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(rf"\b{s}\b"), F.struct(F.lit(s).alias("source_func"), F.lit(i).alias("source_ord"))) for i, s in enumerate(SOURCES)]))
    lines = lines.filter(F.col("text").rlike(rf"\b(?:{'|'.join(SOURCES)})\b"))  # one match where a line mentions none
    return lines.select("sample_id", "line", F.explode(hits).alias("h")).select("sample_id", "line", "h.*")


def sink_hits(lines: DataFrame) -> DataFrame:
    """sample_id, line, sink_func, sink_category, sink_ord: dangerous calls on a line, once per category listing them."""
    listed = [(s, c) for c, names in SINKS for s in names]
    hits = F.array_compact(F.array(*[
        F.when(F.col("text").rlike(rf"\b{s}\s*\("), F.struct(F.lit(s).alias("sink_func"), F.lit(c).alias("sink_category"), F.lit(i).alias("sink_ord")))
        for i, (s, c) in enumerate(listed)
    ]))
    lines = lines.filter(F.col("text").rlike(rf"\b(?:{'|'.join(sorted({s for s, _ in listed}))})\s*\("))
    return lines.select("sample_id", "line", F.explode(hits).alias("h")).select("sample_id", "line", "h.*")


def sink_category(name: Column) -> Column:
    """The first category that lists a sink, else ``unknown``."""
    return F.coalesce(*[F.when(name.isin(*names), F.lit(c)) for c, names in SINKS], F.lit("unknown"))


def paths(samples: DataFrame, id_name: str = "sample_id", code: str = "code", most: int = PATH_CAP) -> DataFrame:
    """Every source of a sample with every sink, once per (source, sink, sink line), the first ``most`` in order.

    Equal keys keep the earliest source line and category, so both sides are reduced before they meet: a source
    counts from its first line, a sink line from its first category, and no more than ``most`` of either can matter.
    """
    lines = lines_of(samples, id_name, code)
    first_source = source_hits(lines).groupBy("sample_id", "source_func", "source_ord").agg(F.min("line").alias("source_line"))
    by_source = Window.partitionBy("sample_id").orderBy("source_line", "source_ord")
    sources = first_source.withColumn("n", F.row_number().over(by_source)).filter(F.col("n") <= most).drop("n")
    by_sink = Window.partitionBy("sample_id").orderBy("sink_ord", "sink_line")
    sinks = sink_hits(lines).groupBy("sample_id", "sink_func", F.col("line").alias("sink_line")).agg(
        F.min(F.struct("sink_ord", "sink_category")).alias("s")
    ).select("sample_id", "sink_func", "sink_line", "s.*")
    sinks = sinks.withColumn("n", F.row_number().over(by_sink)).filter(F.col("n") <= most).drop("n")
    met = sources.join(sinks, "sample_id")
    order = Window.partitionBy("sample_id").orderBy("source_line", "source_ord", "sink_ord", "sink_line")
    return (
        met.withColumn("path_no", F.row_number().over(order)).filter(F.col("path_no") <= most)
        .select("sample_id", "path_no", "source_func", "source_line", "sink_func", "sink_line", "sink_category")
    )


def closing_lines(depth: np.ndarray, starts: list[int]) -> list[int]:
    """For each start, the first later line whose depth is no more than that before the start, else the start. ``depth`` is
    the running depth after each line, with 0 before the first.

    Lines are taken in from the last to the first; of those taken in, only the ones shallower than all nearer lines can
    answer, so they stay in order of depth and a search by halves finds the nearest.
    """
    lines: list[int] = []
    depths: list[int] = []
    ends, at = dict.fromkeys(starts, 0), len(depth)
    for s in sorted(ends, reverse=True):
        while at > s + 1:
            at -= 1
            while depths and depths[-1] >= depth[at]:
                depths.pop()
                lines.pop()
            depths.append(int(depth[at]))
            lines.append(at)
        n = bisect_right(depths, int(depth[s - 1]))
        ends[s] = lines[n - 1] if n else s
    return [ends[s] for s in starts]


@F.pandas_udf(T.StructType([T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]))
def _spans(gaps: pd.Series, heads: pd.Series, braces: pd.Series) -> pd.DataFrame:
    """Start and closing line of each head, from the line feeds between and in heads and the braces of each line."""
    starts, ends = [], []
    for g, h, b in zip(gaps, heads, braces, strict=True):
        own = (1 + np.cumsum(g)[: len(h)] + np.cumsum(h) - h).tolist()
        starts.append(own)
        ends.append(closing_lines(np.concatenate(([0], np.cumsum(b))), own))
    return pd.DataFrame({"starts": starts, "ends": ends})


def functions_of(samples: DataFrame, id_name: str = "sample_id", code: str = "code") -> DataFrame:
    """sample_id, name, start_line, end_line of C definitions.

    A definition ends on the first line after its start where as many braces have closed as opened since it, else on
    its start line. Split at the matched heads, the text before the i-th head tells its line.
    """
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))
    found = samples.select(
        F.col(id_name).alias("sample_id"), F.regexp_extract_all(F.col(code), F.lit(DEFINITION), F.lit(1)).alias("names"),
        F.transform(F.split(F.col(code), DEFINITION, -1), lambda c: count(c, "\n")).alias("gaps"),
        F.transform(F.regexp_extract_all(F.col(code), F.lit(DEFINITION), F.lit(0)), lambda c: count(c, "\n")).alias("heads"),
        F.transform(F.split(F.col(code), "\n"), lambda l: count(l, "{") - count(l, "}")).alias("braces"),
    ).filter(F.size("names") > 0)
    spans = found.select("sample_id", "names", _spans("gaps", "heads", "braces").alias("spans"))
    spans = spans.select("sample_id", F.explode(F.arrays_zip("names", F.col("spans.starts").alias("s"), F.col("spans.ends").alias("e"))).alias("f"))
    each = spans.select("sample_id", F.col("f.names").alias("name"), F.col("f.s").alias("start_line"), F.col("f.e").alias("end_line"))
    return each.filter(~F.col("name").isin(*CONTROL_WORDS))


def call_edges(samples: DataFrame, functions: DataFrame, id_name: str = "sample_id", code: str = "code") -> DataFrame:
    """Distinct sample_id, caller, callee, line: calls on the lines of a function, itself and control words aside.

    A function stands in each bin of ``BIN`` lines that it reaches into, a call in its own; they meet within a bin.
    """
    calls = lines_of(samples, id_name, code).select("sample_id", "line", F.explode(call_names(F.col("text"))).alias("callee"))
    calls = calls.filter(~F.col("callee").isin(*CONTROL_WORDS)).withColumn("bin", F.floor(F.col("line") / BIN))
    bins = F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))
    f = functions.select("sample_id", F.col("name").alias("caller"), "start_line", "end_line", F.explode(bins).alias("bin"))
    met = calls.join(f, ["sample_id", "bin"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")) & (F.col("caller") != F.col("callee")))
    return met.select("sample_id", "caller", "callee", "line").distinct()


def callers(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """sample_id, func, caller: everything that reaches ``func`` (``wanted``: sample_id, func), itself excluded.

    Round i joins what reaches ``func`` in fewer than 2^i calls with the paths of exactly 2^i calls, then doubles those: as
    many rounds as the depth has binary digits, each written to the shared folder. A round that adds nothing ends it,
    since a farther caller would have one at exactly 2^i calls before it; cycles end likewise.
    """
    step = cut(edges.select("sample_id", "caller", "callee").distinct(), "calls")
    seen = cut(wanted.select("sample_id", "func", F.col("func").alias("caller")).distinct(), "callers")
    n = seen.count()
    while True:
        ahead = step.select("sample_id", F.col("callee").alias("via"), F.col("caller").alias("next"))
        reach = seen.withColumnRenamed("caller", "via").join(ahead, ["sample_id", "via"]).select("sample_id", "func", F.col("next").alias("caller"))
        seen = cut(seen.union(reach).distinct(), "callers")
        if (more := seen.count()) == n:
            break
        n = more
        step = _doubled(step)
    return seen.filter("caller <> func")


def _doubled(step: DataFrame) -> DataFrame:
    """Paths of twice as many calls."""
    first = step.select("sample_id", "caller", F.col("callee").alias("via"))
    second = step.select("sample_id", F.col("caller").alias("via"), "callee")
    return cut(first.join(second, ["sample_id", "via"]).select("sample_id", "caller", "callee").distinct(), "calls")


def context(path: DataFrame, edge: DataFrame, samples: DataFrame, id_name: str = "sample_id") -> DataFrame:
    """sample_id, taint_context: up to five paths and ten distinct calls as text, empty without any."""
    shown = path.filter(F.col("path_no") <= CONTEXT_PATHS).withColumn("t", F.format_string("  %d. %s(line %d) -[direct]-> %s(line %d) [%s]", "path_no", "source_func", F.col("source_line").cast("int"), "sink_func", F.col("sink_line").cast("int"), "sink_category"))
    p = shown.groupBy("sample_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path_no", "t"))), lambda x: x["t"]), "\n").alias("p"))
    pairs = edge.groupBy("sample_id", "caller", "callee").agg(F.min("line").alias("line"))
    order = Window.partitionBy("sample_id").orderBy("line", "caller", "callee")
    pairs = pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= CONTEXT_EDGES)
    e = pairs.groupBy("sample_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.format_string("  %s() -> %s()", "caller", "callee").alias("t")))), lambda x: x["t"]), "\n").alias("e"))
    out = samples.select(F.col(id_name).alias("sample_id")).join(p, "sample_id", "left").join(e, "sample_id", "left")
    parts = F.concat_ws("\n", F.concat(F.lit("Taint Analysis Results:\n"), F.col("p")), F.concat(F.lit("\nRelevant call graph:\n"), F.col("e")))
    return out.select("sample_id", parts.alias("taint_context"))


def dangerous_functions(path: DataFrame) -> DataFrame:
    """sample_id, functions: the different sinks its paths reach."""
    return path.groupBy("sample_id").agg(F.sort_array(F.collect_set("sink_func")).alias("functions"))
