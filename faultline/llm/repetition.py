"""Repetition rules from suffix arrays.

The words of a document are ranked by prefix doubling into a suffix array. Neighbours in it with a longest common
prefix of at least ``MIN_WORDS`` delimit the intervals of repeated substrings; at each position the longer of the
two neighbouring prefixes is the longest substring starting there that occurs elsewhere in the document. The union
of those spans is what the document repeats: their covered fraction and the longest of them are limited.

Many documents share one array: their words carry the document's number, so no prefix crosses documents, and the
sort stays in numpy. A call holds about ``ARRAY_WORDS`` words, or one longer document, for which it needs 4 bytes a word
and doubling: a text of five million words that repeats half of itself holds some 0.5 GB. Row-wise, no shuffle.

Defined cases: a null text has no words and counts 0 everywhere, an empty one likewise, and both fail the base rule
(under ``FEW_WORDS``); repeated rows are judged each; an empty table gives no rows; whole texts are read whatever
their length; other columns are ignored by the query and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, table, text_filter, text_map

MIN_WORDS, FEW_WORDS, MOST_PERCENT, LONGEST_WORDS = 8, 20, 30, 250
SYMBOLS = "#*$%&|<>"
ARRAY_WORDS = 200_000

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, n_intervals long, base_failed boolean, kept boolean"
)


def suffix_repeats(words: np.ndarray, owner: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For word numbers of several documents end to end (``owner`` ascending): per position the length of the longest
    substring of at least ``least`` words starting there and found elsewhere in its document, else 0; and whether the
    position opens an interval of such suffixes in the array."""
    n = len(words)
    reach, opens = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    if n < 2:
        return reach, opens
    key = owner.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)  # one copy a level is kept
    new = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    rank[order] = np.repeat(new, np.diff(np.append(new, n)))
    del key, sorted_key

    def tied() -> np.ndarray:
        r = rank[order]
        same = r[1:] == r[:-1]
        return np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))

    ends = np.searchsorted(owner, owner, side="right")  # where a position's document ends
    levels: list[tuple[int, np.ndarray]] = [(1, rank.copy())]
    h, active = 1, tied()
    while len(active):
        p = order[active]
        q = p + h
        beyond = q >= ends[p]
        second = np.where(beyond, 0, rank[np.minimum(q, n - 1)] + 1)
        both = rank[p].astype(np.int64) * (n + 1) + second
        by = np.argsort(both, kind="stable")
        both, p = both[by], p[by]
        order[active] = p
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        starts = np.flatnonzero(fresh)
        rank[p] = np.repeat(active[starts], np.diff(np.append(starts, len(p))))
        h *= 2
        levels.append((h, rank.copy()))
        still = tied_within(rank, order, active)
        active = still
    # neighbours whose common prefix is long enough, measured by the levels from the longest down
    a, b = order[:-1], order[1:]
    first = max((lv for lv in levels if lv[0] <= least), key=lambda lv: lv[0])
    some = np.flatnonzero(first[1][a] == first[1][b])
    a, b = a[some].copy(), b[some].copy()
    a0, b0 = a.copy(), b.copy()
    for step, ranks in reversed(levels):
        inside = (a < n) & (b < n)
        equal = np.zeros(len(a), dtype=bool)
        equal[inside] = ranks[a[inside]] == ranks[b[inside]]
        a[equal] += step
        b[equal] += step
    common = a - a0
    long = common >= least
    np.maximum.at(reach, a0[long], common[long])
    np.maximum.at(reach, b0[long], common[long])
    before = np.zeros(n, dtype=bool)  # does the neighbour before share enough as well
    before[b0[long]] = True
    opens[a0[long]] = ~before[a0[long]]
    return reach, opens


def tied_within(rank: np.ndarray, order: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Places of the array, among ``active``, that still share their rank with a neighbour."""
    r = rank[order[active]]
    same = (r[1:] == r[:-1]) & (active[1:] == active[:-1] + 1)
    return active[np.append(same, False) | np.insert(same, 0, False)]


def make_report(few: int = FEW_WORDS, percent: int = MOST_PERCENT, longest: int = LONGEST_WORDS, least: int = MIN_WORDS):
    """() -> (texts -> one list per field of ``FIELDS``)."""

    def make():
        def report(texts: Sequence[str | None]):
            rows: list[list] = []
            begin, held, run = 0, 0, []
            for i, text in enumerate(texts):
                words = text.encode().split() if text else []
                if run and held + len(words) > ARRAY_WORDS:
                    rows += judge(texts[begin:i], run)
                    begin, held, run = i, 0, []
                run.append(words)
                held += len(words)
            if run:
                rows += judge(texts[begin:], run)
            return list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS.split(", "))

        def judge(texts, split) -> list[list]:
            sizes = np.array([len(w) for w in split], dtype=np.int64)
            number: dict[bytes, int] = {}
            words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), dtype=np.int64, count=int(sizes.sum()))
            owner = np.repeat(np.arange(len(split)), sizes)
            reach, opens = suffix_repeats(words, owner, least)
            ends = np.cumsum(sizes)
            at = np.flatnonzero(reach)
            covered = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + reach[at], -1)
            cover = np.append(0, np.cumsum(np.cumsum(covered[:-1]) > 0))
            opened = np.append(0, np.cumsum(opens))
            starts = ends - sizes
            repeated = cover[ends] - cover[starts]
            intervals = opened[ends] - opened[starts]
            rows = []
            for k, text in enumerate(texts):
                text = text or ""
                n = int(sizes[k])
                lines = [x for x in text.split("\n") if x.strip(BLANKS)]
                most = int(reach[starts[k] : ends[k]].max()) if n else 0
                spread = int(repeated[k])
                failed = n < few or 100 * spread > percent * n
                rows.append([
                    n, len(text) - sum(text.count(c) for c in BLANKS), sum(text.count(c) for c in SYMBOLS),
                    len(lines) - len(set(lines)), spread, most, int(intervals[k]), failed, not failed and most <= longest,
                ])
            return rows

        return report

    return make


def repetition_report(docs: DataFrame, id_name: str, text_name: str, **limits) -> DataFrame:
    """doc_id and ``FIELDS``, one row per document."""
    return text_map(docs, F.col(text_name), [F.col(id_name).alias("doc_id")], FIELDS, make_report(**limits))


def keep_unrepetitive(docs: DataFrame, text_name: str = "text", **limits) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    make = make_report(**limits)

    def verdicts():
        report = make()
        return lambda texts: report(texts)[-1]

    return text_filter(docs, text_name, verdicts)


def op6_repetition(spark, sf_dir: str) -> DataFrame:
    found = repetition_report(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.drop("longest_repeat", "n_intervals")


def _covered_sql(size: int) -> str:
    """Positions covered by windows of ``size`` words that occur twice or more in their document."""
    return f"""SELECT doc_id, count(*) AS covered FROM (
      SELECT DISTINCT doc_id, i + d AS pos FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
          SELECT doc_id, i, hash(w[i:i + {size - 1}]) AS g FROM t, unnest(range(1, len(w) - {size - 2})) AS r(i) WHERE len(w) >= {size}))
      , unnest(range({size})) AS s(d) WHERE times > 1) GROUP BY 1"""


def _longer_sql(size: int) -> str:
    """Documents where some window of ``size`` words occurs twice or more."""
    return f"""SELECT DISTINCT doc_id FROM (SELECT doc_id, hash(w[i:i + {size - 1}]) AS g FROM t, unnest(range(1, len(w) - {size - 2})) AS r(i) WHERE len(w) >= {size}) GROUP BY doc_id, g HAVING count(*) > 1"""


#: The rules in DuckDB by counting windows, with no suffix array.
OP6_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM t),
c AS ({_covered_sql(MIN_WORDS)}), o AS ({_longer_sql(LONGEST_WORDS + 1)}),
b AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
  (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(covered, 0)::BIGINT AS n_repeat_words, o.doc_id IS NOT NULL AS longer
  FROM t JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)),
f AS (SELECT *, n_words < {FEW_WORDS} OR 100 * n_repeat_words > {MOST_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT longer AS kept FROM f"""
