"""Text functions over source code, as Column expressions that stay in generated code (F2 alone needs Python)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..rules import ANY_HEAD, APART, CONTROL_WORDS, DEFINITION_HEAD, DIRT, TAILS

TOKEN = r"\w+|[^\w\s]"
CALL = r"\b(\w+)\s*\("
BEGIN, END, PAD = "<s>", "</s>", "<pad>"
#: A piece of C-like source: a comment, a literal, or anything between.
PIECE = r"""(?s)//[^\n]*|/\*.*?\*/|'(?:\\.|[^\\'])*+'|"(?:\\.|[^\\"])*+"|[^/'"]+|."""


def squeeze(c: Column) -> Column:
    """Runs of white space, Unicode's included, become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at the ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def tokens(c: Column) -> Column:
    """Words and single signs in order; the default where no trained tokenizer is given."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def framed(token_array: Column, block_size: int) -> Column:
    """Cut to ``block_size - 2`` tokens, framed by begin and end, padded to ``block_size``."""
    body = F.concat(F.array(F.lit(BEGIN)), F.slice(token_array, 1, block_size - 2), F.array(F.lit(END)))
    return F.slice(F.concat(body, F.array_repeat(F.lit(PAD), block_size)), 1, block_size)


def snippet(token_array: Column, n_tokens: int = 50, n_chars: int = 200) -> Column:
    return F.substring(F.array_join(F.slice(token_array, 1, n_tokens), " "), 1, n_chars)


def without_blank_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: strip(x) != ""), "\n")


def strip_comments(c: Column) -> Column:
    """C-like source without comments: each becomes one space, literals stay, blank lines go."""
    pieces = F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
    kept = F.transform(pieces, lambda p: F.when(p.startswith("//") | p.startswith("/*"), F.lit(" ")).otherwise(p))
    return without_blank_lines(F.array_join(kept, ""))


@F.pandas_udf(StringType())
def strip_python_comments(source: pd.Series) -> pd.Series:
    """Python source without comments and docstrings, blank lines dropped; source that does not tokenize is kept."""
    import io
    import tokenize

    quiet = {tokenize.COMMENT}
    opening = {tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.NL}

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        lines = text.split("\n")
        try:
            found = list(tokenize.generate_tokens(io.StringIO(text).readline))
        except (tokenize.TokenError, IndentationError, SyntaxError):
            return text
        before = tokenize.NEWLINE
        spans = []
        for i, t in enumerate(found):
            alone = t.type == tokenize.STRING and before in opening and found[i + 1].type in (tokenize.NEWLINE, tokenize.NL, tokenize.ENDMARKER)
            if t.type in quiet or alone:
                spans.append((t.start, t.end))
            if t.type not in quiet:
                before = t.type
        for (r0, c0), (r1, c1) in reversed(spans):
            lines[r0 - 1 : r1] = [lines[r0 - 1][:c0] + lines[r1 - 1][c1:]]
        return "\n".join(x for x in lines if x.strip())

    return source.map(clean)


def clean_words(c: Column, contractions: bool = True) -> Column:
    """Lower-case text of letters, digits and few signs, those set apart; signs of grouping keep their escape."""
    c = F.regexp_replace(c, DIRT, " ")
    if contractions:
        for tail in TAILS:
            c = F.replace(c, F.lit(tail), F.lit(f" {tail}"))
        for sign, apart in APART:
            c = F.replace(c, F.lit(sign), F.lit(apart))
    return F.lower(F.trim(F.regexp_replace(c, r"\s{2,}", " ")))


def function_name(code: Column, default: str = "vulnerable_function") -> Column:
    """The first definition's name; of each of two patterns only the first match is looked at."""
    skip = (*CONTROL_WORDS, "main")
    found = [F.regexp_extract(code, p, 1) for p in (DEFINITION_HEAD, ANY_HEAD)]
    return F.coalesce(*[F.when((f != "") & ~f.isin(*skip), f) for f in found], F.lit(default))


def call_names(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(CALL), F.lit(1))


def defines_main(code: Column) -> Column:
    return code.rlike(r"\bint\s+main\s*\(")


def numbered(code: Column) -> Column:
    """Lines with their numbers, as a listing."""
    lines = F.transform(F.split(code, "\n"), lambda line, i: F.format_string("  %4d  %s", i + 1, line))
    return F.array_join(lines, "\n")


def cache_key(code: Column, vuln_type: Column, exploit_id: Column) -> Column:
    return F.md5(F.concat_ws("|", code, vuln_type, exploit_id))


def is_valid(code: Column, payload: Column) -> Column:
    """Both hold something other than white space."""
    return (strip(code) != "") & (strip(payload) != "")


def _sections(code: Column, context: Column) -> list[Column]:
    """The taint section, which says so where there is no context, the listing, and what an answer has to hold."""
    known = F.concat(F.lit("### Taint context\n"), context)
    return [
        F.when(F.length(context) > 0, known).otherwise("### Taint context\nNone was found; judge by the code alone."),
        F.concat(F.lit("### Code\n"), numbered(code)),
        F.lit('### Answer\nOne JSON object: "verdict" (true_positive, false_positive or uncertain), "confidence" from 0 to 1, "reasoning".'),
    ]


def triage_prompt(code: Column, vuln_type: Column, cwe: Column, score: Column, context: Column) -> Column:
    """A review request that begins with the detection's findings; a missing weakness reads N/A."""
    weakness = F.when(F.length(cwe) > 0, cwe).otherwise("N/A")
    found = F.format_string("### Detection\nType: %s\nWeakness: %s\nScore: %.4f", vuln_type, weakness, score)
    return F.concat_ws("\n\n", found, *_sections(code, context))


def review_prompt(code: Column, context: Column) -> Column:
    """A review request without a detection."""
    return F.concat_ws("\n\n", *_sections(code, context))
