"""Splits, samples, deduplication and mixing of old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_split(samples: DataFrame, splits: dict[str, DataFrame], id_name: str = "idx") -> DataFrame:
    """Rows whose id is listed by a split, with its name; an id listed by several appears in each."""
    listed = None
    for name, ids in splits.items():
        part = ids.select(F.col(ids.columns[0]).alias(id_name)).distinct().withColumn("split", F.lit(name))
        listed = part if listed is None else listed.unionByName(part)
    return samples.join(listed, id_name)


def dedup_by_content(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row, by ``order``, of each text; a hash stands for the text in the shuffle, aggregated before it.

    A null text is a text. Rows that share text and order count once; rows that share only their order are told apart."""
    content = F.coalesce(F.md5(text), F.lit(""))
    first = rows.groupBy(content.alias("__md5")).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    marked = rows.withColumn("__key", content)
    kept = marked.join(first, (F.col("__key") == F.col("__md5")) & F.col(order).eqNullSafe(F.col("__first")))
    single = kept.filter("__n = 1").select(*rows.columns)
    return single.unionByName(kept.filter("__n > 1").dropDuplicates(["__key"]).select(*rows.columns))


def dedup_by_key(rows: DataFrame, keys: list[str], order: list[Column], head: int | None = None, within: list[str] | None = None) -> DataFrame:
    """The first row of each key, then at most ``head`` of those, both by ``order``; ``within`` bounds both to a group."""
    group = list(within or [])
    out = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group, *keys).orderBy(*order))).filter("__n = 1")
    if head is not None:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__n") <= head)
    return out.drop("__n")


def hash_order(id_name: str, seed: int) -> list[Column]:
    """A seeded order in which any prefix is a sample; every engine with MD5 has the same one."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_name).cast("string"))), F.col(id_name)]


DIGITS = 4


def sample(rows: DataFrame, share: float, id_name: str = "idx", seed: int = 10) -> DataFrame:
    """``int(share * n)`` rows, the first in hash order, without sorting them.

    Rows are counted by the first digits of their hash; digits below the one where the share is reached are taken
    whole, and only the rows of that one are ranked. What reaches the driver is one count per digit group.
    """
    order, _ = hash_order(id_name, seed)
    marked = rows.withColumn("__h", order).withColumn("__d", F.substring("__h", 1, DIGITS))
    counts = sorted((r["__d"], r["count"]) for r in marked.groupBy("__d").count().collect())  # at most 16^DIGITS
    left, last = int(share * sum(n for _, n in counts)), ""
    for digits, n in counts:
        last = digits
        if n > left:
            break
        left -= n
    else:
        return rows
    edge = marked.filter(F.col("__d") == last).withColumn("__n", F.row_number().over(Window.partitionBy("__d").orderBy("__h", id_name)))
    return marked.filter(F.col("__d") < last).drop("__h", "__d").unionByName(edge.filter(F.col("__n") <= left).drop("__h", "__d", "__n"))


def replay_mix(new: DataFrame, old: DataFrame, share: float, id_name: str = "idx", seed: int = 10) -> DataFrame:
    """All new rows and a sampled share of the old ones, in hash order."""
    both = new.withColumn("is_new", F.lit(1)).unionByName(sample(old, share, id_name, seed).withColumn("is_new", F.lit(0)))
    return both.orderBy(*hash_order(id_name, seed + 1))


def mask(rows: DataFrame, ids: DataFrame, id_name: str = "idx") -> DataFrame:
    """``rows`` with ``selected``: whether their id is among ``ids``."""
    listed = ids.select(F.col(ids.columns[0]).alias(id_name)).distinct().withColumn("__in", F.lit(True))
    return rows.join(listed, id_name, "left").withColumn("selected", F.coalesce("__in", F.lit(False))).drop("__in")
