"""URL filtering by host/path rules and a weighted vocabulary.

Rules come first: a rule names a host, which it fits together with all its subdomains, and a path prefix; the
longest fitting rule gives the verdict. Elsewhere the vocabulary decides: one Aho-Corasick pass over the lower-cased
URL behind its scheme finds every term, a hit counts only between characters that are not letters or digits of any
script, and a URL is blocked on one strict term or on ``SOFT_NEEDED`` different soft ones. The terms are those of
``url_terms.txt`` beside this module; others can be given.

Row-wise, no shuffle; only the URL column is read. The automaton is a constant of the vocabulary's size.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and is allowed; repeated rows
are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_map

RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
SOFT_NEEDED = 2


def inflected(term: str) -> list[str]:
    """A term and its English plural."""
    if term.endswith(("s", "x", "ch", "sh")):
        return [term, term + "es"]
    if term.endswith("y") and term[-2] not in "aeiou":
        return [term, term[:-1] + "ies"]
    return [term, term + "s"]


def read_vocabulary(text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict terms, soft terms) from lines ``weight language: terms``; those of language ``en`` also in the plural."""
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            head, _, terms = line.partition(":")
            weight, language = head.split()
            for term in terms.split():
                found[weight].update(inflected(term) if language == "en" else [term])
    return tuple(sorted(found["strict"])), tuple(sorted(found["soft"] - found["strict"]))


#: Terms that block alone, and terms of which ``SOFT_NEEDED`` different ones do; ``judge_urls`` takes others.
STRICT, SOFT = read_vocabulary(files(__package__).joinpath("url_terms.txt").read_text(encoding="utf-8"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    """What stands behind the scheme, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def vocabulary_hits(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
    """() -> (texts -> (number of different strict terms, number of different soft terms))."""

    def make():
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for kind, terms in (("s", strict), ("w", soft)):
            for term in terms:
                automaton.add_word(term, (kind, term))
        automaton.make_automaton()

        def inside(text: str, i: int) -> bool:
            return 0 <= i < len(text) and text[i].isalnum()

        def hits(texts):
            hard, light = [], []
            for text in texts:
                seen = set()
                for end, (kind, term) in automaton.iter(text or ""):
                    if not inside(text, end + 1) and not inside(text, end - len(term)):
                        seen.add((kind, term))
                hard.append(sum(k == "s" for k, _ in seen))
                light.append(len(seen) - hard[-1])
            return hard, light

        return hits

    return make


def judge_urls(
    pages: DataFrame, id_name: str, url_name: str, rules=RULES, strict=STRICT, soft=SOFT, soft_needed: int = SOFT_NEEDED
) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_terms, soft_terms: one row per page."""
    url = F.col(url_name).cast("string")
    parts = pages.select(F.col(id_name).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), rest_of(url).alias("rest"))
    counted = text_map(
        parts, F.col("rest"), [F.col("page_id"), F.col("host"), F.col("path")],
        "strict_terms long, soft_terms long", vocabulary_hits(strict, soft),
    )
    ruled = counted.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when((F.col("strict_terms") >= 1) | (F.col("soft_terms") >= soft_needed), "block").otherwise("allow")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "strict_terms", "soft_terms")


def op10_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url")


def _rule_sql() -> str:
    whens = ""
    for rule, _ in sorted(RULES, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        whens += f" WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN '{rule}'"
    return f"CASE{whens} END"


def _count_sql(terms: Sequence[str]) -> str:
    return "(" + " + ".join(f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}]){x}([^\\p{{L}}\\p{{N}}]|$)')::BIGINT" for x in terms) + ")"


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The same judgement in DuckDB, with one regular expression per term in place of the automaton.
OP10_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), {_LOWER}), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(translate(regexp_extract(url, '^.*?://(.*)$', 1, 's'), {_LOWER}), '') AS t FROM pages),
h AS (SELECT page_id, host, path, {_rule_sql()} AS rule, t FROM p),
c AS (SELECT page_id, host, path, rule, {_count_sql(STRICT)} AS strict_terms, {_count_sql(SOFT)} AS soft_terms FROM h)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)}
            WHEN strict_terms >= 1 OR soft_terms >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END AS verdict,
       strict_terms, soft_terms
FROM c"""
