"""Reading verdicts out of review responses: finding the JSON in the prose, then its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..rules import CODE_FENCE, JSON_FENCE, NESTED_OBJECT, TRIAGE_VERDICTS, VERDICT_OBJECT

FENCE = "```"


def _without_fence(text: Column) -> Column:
    """What stands inside a fence that opens the text; null where none does."""
    body = F.regexp_replace(text, r"(?s)\A[^\n]*\n", "")
    inner = F.regexp_replace(body, r"(?s)\s*```\s*\z", "")
    return F.when(text.startswith(FENCE), inner)


def json_candidates(response: Column) -> Column:
    """Texts that may be the JSON, most trusted first: fenced, raw, an object naming a verdict, the widest braces."""
    text = strip(response)
    named = F.regexp_extract_all(response, F.lit(VERDICT_OBJECT), F.lit(0))
    widest = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return F.concat(F.array(_without_fence(text), text), named, F.array(widest))


def extracted_json(response: Column) -> Column:
    """The first candidate that parses, as text; null when none does."""
    return F.get(F.filter(json_candidates(response), lambda c: c.isNotNull() & (strip(c) != "") & F.try_parse_json(c).isNotNull()), 0)


def parse_triage(responses: DataFrame, response: str = "response") -> DataFrame:
    """Adds verdict, confidence, reasoning. Unknown verdicts are uncertain, confidence is held in [0, 1], 0.5 where it
    is no number; a response without JSON is uncertain with confidence 0."""
    raw = F.coalesce(F.col(response), F.lit(""))
    out = responses.withColumn("__json", extracted_json(raw)).withColumn("__v", F.try_parse_json("__json"))
    verdict = F.try_variant_get("__v", "$.verdict", "string")
    # a number, or a string or boolean that converts to one; nothing else
    stated = F.coalesce(F.try_variant_get("__v", "$.confidence", "double"), F.try_variant_get("__v", "$.confidence", "string").try_cast("double"))
    said = F.try_variant_get("__v", "$.reasoning", "string")
    none = F.col("__json").isNull()
    return out.select(
        *responses.columns,
        F.when(~none & verdict.isin(*TRIAGE_VERDICTS), verdict).otherwise("uncertain").alias("verdict"),
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(stated, F.lit(0.5))))).alias("confidence"),
        F.when(none, F.concat(F.lit("Failed to parse LLM response: "), F.substring(raw, 1, 500))).otherwise(F.coalesce(said, F.lit("No reasoning provided"))).alias("reasoning"),
    )


def adapter_json(response: Column) -> Column:
    """JSON of a generator's response: a ``json`` fence, else braces nested once; null when neither parses."""
    fenced = F.regexp_extract(response, JSON_FENCE, 1)
    braces = F.regexp_extract(response, NESTED_OBJECT, 0)
    return F.coalesce(*[F.when((c != "") & F.try_parse_json(c).isNotNull(), c) for c in (fenced, braces)])


def code_block(response: Column) -> Column:
    """The first fenced C block if it has a main function, else null."""
    body = strip(F.regexp_extract(response, CODE_FENCE, 1))
    return F.when(F.contains(body, F.lit("main(")) | F.contains(body, F.lit("int main")), body)
