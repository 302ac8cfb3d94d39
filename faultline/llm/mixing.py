"""Mixing sources to target weights along a time-varying curriculum.

Targets. Every source has a weight and the mix a budget in words. A source's target is ``min(cap, level * weight)``
for the one level that spends the budget: what a weight asks for above the cap is shared anew by weight.

Taking. The documents of a source form a stream in the order of a seeded hash; the mix takes the first ``target``
words of that stream repeated, so that a source short of its target repeats and a source beyond it is cut, at most
one document of a source being taken in part.

Positions. A source's weight over training time is a schedule, piecewise linear on [0, 1] and scaled to area 1.
Its integral is the share of the source's words wanted by a time; inverted at a document's place in the stream it
gives the document's training position. Documents are range-sorted by position.

At scale. Sizes are summed per (source, hash prefix) before any shuffle; prefix sums over the prefixes and then
within one (source, prefix) replace a running sum over a whole source, so a source that holds a third of all rows
is spread over ``PREFIXES`` groups. Only the table of sources, one row of four numbers each, meets in one task: some
millions of sources sort there, which is what a list of web hosts comes to.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; a
null doc_id is ordered as the string "null"; ties in the hash (repeated rows) go by size; a source without words
has target 0; an empty table gives no rows. Columns of the input that clash with the added names are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import WORD_PATTERN, fresh_name, quoted, table, word_count

WEIGHTS, BUDGET, CAP, SEED = (5, 2, 1), (3, 2), 2, "mix-1"
HEX_DIGITS = 3
PREFIXES = 16**HEX_DIGITS
#: Weight of a source over training time as (time, weight) knots, dealt to the sources in turn like WEIGHTS.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
)


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(share before, time, weight, slope, share after) of each piece of a schedule scaled to area 1."""
    pieces = list(zip(knots, knots[1:], strict=False))
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces)
    out, share = [], 0.0
    for (t0, w0), (t1, w1) in pieces:
        after = share + (t1 - t0) * (w0 + w1) / 2 / area
        out.append((share, t0, w0 / area, (w1 - w0) / (t1 - t0) / area, after))
        share = after
    return out


def invert(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which a source has been asked for ``share`` of its words."""
    found = None
    for before, time, weight, slope, after in reversed(segments(knots)):
        u = share - F.lit(before)
        at = F.lit(time) + u * F.lit(2.0) / (F.lit(weight) + F.sqrt(F.lit(weight * weight) + F.lit(2.0 * slope) * u))
        found = at if found is None else F.when(share < F.lit(after), at).otherwise(found)
    return found


def source_targets(per_source: DataFrame, weights=WEIGHTS, budget=BUDGET, cap: int = CAP) -> DataFrame:
    """Adds rank, weight and target to one row per source (``source``, ``source_size``)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(every) * F.lit(budget[0]) / F.lit(budget[1])
    table_of = F.array(*[F.lit(w) for w in weights])
    return (
        per_source.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(table_of, F.pmod("rank", F.lit(len(weights))) + 1).cast("long"))
        .withColumn("capped", F.col("source_size") * cap)
        .withColumn("ratio", F.col("capped") / F.col("weight"))
        .withColumn("level", (wanted - F.coalesce(F.sum("capped").over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
        .withColumn("target", F.least(F.col("capped").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("capped").cast("double"))))
        .select("source", "source_size", "rank", "target")
    )


ADDED = ("size", "source_size", "target", "taken", "position", "repeat_position")
LATER = "later_positions"


def mix(
    docs: DataFrame,
    id_name: str = "doc_id",
    text_name: str = "text",
    source_name: str = "source",
    weights: Sequence[int] = WEIGHTS,
    budget: tuple[int, int] = BUDGET,
    cap: int = CAP,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: str = SEED,
    ordered: bool = True,
    prefix: str = "",
    counted: str | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words), position and repeat_position (times in [0, 1]).

    With a ``cap`` above 2 there is also later_positions, one time for each pass after the second that takes the row.

    ``counted`` names a column that has the sizes already; without it the words of the text are counted, once for the
    sums and once for the rows.

    ``ordered`` range-sorts the rows by position; ``training_rows`` sorts by itself. ``prefix`` goes before the added
    names; columns of ``docs`` that still clash with them are dropped."""
    added = {x: prefix + x for x in (*ADDED, *([LATER] if cap > 2 else []))}
    kept = [c for c in docs.columns if c.lower() not in added.values()]
    # names of our own beside those of docs
    size, group, order, part, begin, size_of, rank, target, once, again, first, second = (
        fresh_name(docs, f"__mix_{x}") for x in ("n", "group", "order", "part", "begin", "of", "rank", "to", "once", "again", "first", "second")
    )
    base = (
        docs.select(*map(quoted, kept))
        .withColumn(size, F.coalesce(F.col(counted).cast("long"), F.lit(0)) if counted else word_count(F.col(text_name)))
        .withColumn(group, F.coalesce(F.concat(F.lit("s"), F.col(source_name).cast("string")), F.lit("n")))
        .withColumn(order, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_name).cast("string"), F.lit("null")))))
        .withColumn(part, F.substring(order, 1, HEX_DIGITS))
    )
    parts = base.groupBy(group, part).agg(F.sum(size).alias(size_of))
    per_source = parts.groupBy(group).agg(F.sum(size_of).alias("source_size")).select(
        F.when(F.col(group) != "n", F.substring(group, 2, 1 << 30)).alias("source"), "source_size"
    )
    targets = source_targets(per_source, weights, budget, cap).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias(group),
        F.col("source_size").alias(size_of), F.col("rank").alias(rank), F.col("target").alias(target),
    )
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(group, part, F.coalesce(F.sum(size_of).over(earlier), F.lit(0)).alias(begin)).join(targets, group)
    within = Window.partitionBy(group, part).orderBy(order, size).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.floor(target)
    placed = (
        base.join(starts, [group, part])
        .withColumn(begin, F.col(begin) + F.coalesce(F.sum(size).over(within), F.lit(0)))
        .withColumn(once, F.greatest(F.lit(0), F.least(F.col(size), asked - F.col(begin))))
        .withColumn(again, F.greatest(F.lit(0), F.least(F.col(size), asked - F.col(size_of) - F.col(begin))))
    )

    def position(offset: Column) -> Column:
        share = F.try_divide(offset.cast("double"), F.col(target))
        found = None
        for k, knots in enumerate(schedules):
            at = invert(share, knots)
            found = at if found is None else F.when(F.pmod(F.col(rank), F.lit(len(schedules))) == k, at).otherwise(found)
        return found

    placed = placed.withColumn(first, F.when(F.col(once) > 0, position(F.col(begin)))).withColumn(
        second, F.when(F.col(again) > 0, position(F.col(begin) + F.col(size_of)))
    )
    if ordered:
        placed = placed.orderBy(F.col(first).asc_nulls_last(), order)
    passed = lambda p: F.greatest(F.lit(0), F.least(F.col(size), asked - F.col(size_of) * p - F.col(begin)))
    passes = F.sequence(F.lit(2), F.lit(max(cap, 3) - 1))
    made = {
        "size": F.col(size), "source_size": F.col(size_of), "target": F.col(target), "taken": F.col(once) + F.col(again),
        "position": F.col(first), "repeat_position": F.col(second),
    }
    if cap > 2:
        made["taken"] += F.aggregate(F.transform(passes, passed), F.lit(0).cast("long"), lambda a, b: a + b)
        made[LATER] = F.transform(F.filter(passes, lambda p: passed(p) > 0), lambda p: position(F.col(begin) + F.col(size_of) * p))
    return placed.select(*map(quoted, kept), *[made[x].alias(added[x]) for x in added])


def training_rows(
    mixed: DataFrame, columns: Sequence[str], id_name: str = "doc_id", text_name: str = "text", prefix: str = ""
) -> DataFrame:
    """One row of ``columns`` per time a mixed document is taken, in training order; a part taken is a part of its text."""
    size, taken, position, repeat = (F.col(prefix + x) for x in ("size", "taken", "position", "repeat_position"))
    copies = F.filter(
        F.array(
            F.struct(position.alias("at"), F.least(taken, size).alias("words")),
            F.struct(repeat.alias("at"), F.least(taken - size, size).alias("words")),
        ),
        lambda x: x["words"] > 0,
    )
    if prefix + LATER in mixed.columns:
        later = F.transform(F.col(prefix + LATER), lambda at, i: F.struct(at.alias("at"), F.least(taken - size * (i + 2), size).alias("words")))
        copies = F.concat(copies, later)
    copy = fresh_name(mixed, "__copy")
    words = F.col(copy)["words"]
    pieces = F.split(F.col(text_name), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    begin = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    out = mixed.withColumn(copy, F.explode(copies)).orderBy(F.col(copy)["at"], F.md5(F.col(id_name).cast("string")))
    return out.select(*[F.when(words < size, begin).otherwise(F.col(quoted(c))).alias(c) if c == text_name else F.col(quoted(c)) for c in columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    words = word_count(F.col("text")).alias("words")
    sizes = cut(table(spark, sf_dir, "documents").select("doc_id", "source", words), "sizes")  # texts are read once
    mixed = mix(sizes, counted="words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "repeat_position")


def _invert_sql(share: str, knots) -> str:
    parts = segments(knots)
    text = ""
    for i, (before, time, weight, slope, after) in enumerate(parts):
        u = f"({share} - {before!r}::DOUBLE)"
        at = f"({time!r}::DOUBLE + {u} * 2.0::DOUBLE / ({weight!r}::DOUBLE + sqrt({weight * weight!r}::DOUBLE + {2.0 * slope!r}::DOUBLE * {u})))"
        text += f"WHEN {share} < {after!r}::DOUBLE THEN {at} " if i < len(parts) - 1 else f"ELSE {at} END"
    return ("CASE " + text) if len(parts) > 1 else text.removeprefix("ELSE ").removesuffix(" END")


def _position_sql(offset: str) -> str:
    share = f"(({offset})::DOUBLE / target)"
    whens = " ".join(f"WHEN rank % {len(SCHEDULES)} = {k} THEN {_invert_sql(share, s)}" for k, s in enumerate(SCHEDULES))
    return f"CASE {whens} END"


#: The mix restated for DuckDB, with a plain running sum over each source.
OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, 'null'))) AS k,
         coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
c AS (SELECT *, source_size * {CAP} AS capped, (source_size * {CAP})::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * {BUDGET[0]} / {BUDGET[1]}
        - coalesce(sum(capped) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lam FROM c),
t AS (SELECT source, source_size, rank, least(capped::DOUBLE, coalesce((SELECT max(lam) FROM l WHERE lam <= ratio) * weight, capped::DOUBLE)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, floor(t.target)::BIGINT AS asked,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, asked - start))::BIGINT AS once, greatest(0, least(size, asked - source_size - start))::BIGINT AS again FROM p)
SELECT doc_id, size, source_size, target, once + again AS taken,
       CASE WHEN once > 0 THEN {_position_sql("start")} END AS position,
       CASE WHEN again > 0 THEN {_position_sql("start + source_size")} END AS repeat_position
FROM q"""
