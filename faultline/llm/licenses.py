"""License scan by template markup.

A template is wording with marked regions: ``[[ ... ]]`` is optional and may nest, ``{{n}}`` stands for at most ``n``
words of any kind. It is compiled into an automaton over words; a text carries the template where the automaton
accepts a run of its words, that is, where all mandatory wording stands exactly, in order. The base phrases are
templates without regions. A match scores its mandatory words over the words it spans, so 1 without any region used.

The templates are those of ``license_templates.txt`` beside this module, whole notices with nested regions among them;
others can be given. Automata start only at words that some template can begin with, so most texts cost one set test.
Row-wise, no shuffle.

Defined cases: a null text is empty; no match gives empty label strings, null first and last word and score 0; of the
runs a template accepts from one start the longest counts; repeated rows are scanned each; an empty table gives no
rows; whole texts are scanned whatever their length; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from importlib.resources import files

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_map

#: (wording, label) of the base phrases.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: What a template consists of: region marks and words.
MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+\}\}")


def read_templates(text: str) -> tuple[tuple[str, str], ...]:
    """(template, label) of each line ``label: wording``; blank lines and those that begin with ``#`` are left out."""
    out = []
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            label, _, template = line.partition(":")
            words, marks = MARKUP.split(template), MARKUP.findall(template)
            plain = [w.encode().translate(WORD_BYTES).decode().split() for w in words]
            out.append((" ".join([*plain[0], *(x for m, w in zip(marks, plain[1:], strict=True) for x in (m, *w))]), label.strip()))
    return tuple(out)


#: Bytes of words: digits, small letters (capitals become small), and everything beyond ASCII; the rest separates.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


#: (template, label) of the wider scan; ``scan_licenses`` takes others.
TEMPLATES = read_templates(files(__package__).joinpath("license_templates.txt").read_text(encoding="utf-8"))


class Automaton:
    """States 0..n-1; ``steps[s]`` maps a word to states, ``any_word[s]`` lists states reached by any word."""

    def __init__(self, template: str) -> None:
        self.steps: list[dict[bytes, list[int]]] = []
        self.any_word: list[list[int]] = []
        self.free: list[list[int]] = []
        self.mandatory = 0
        tokens = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template)
        first = self.state()
        last, rest = self.build(tokens, 0, first, 0)
        if rest != len(tokens):
            raise ValueError(f"unbalanced template: {template!r}")
        self.accepting = last
        self.begin = self.closure({first})
        if self.accepting in self.begin:
            raise ValueError(f"template without mandatory wording: {template!r}")
        if any(self.any_word[s] for s in self.begin):
            raise ValueError(f"template begins with a replaceable region: {template!r}")
        self.first_words = {w for s in self.begin for w in self.steps[s]}

    def state(self) -> int:
        self.steps.append({})
        self.any_word.append([])
        self.free.append([])
        return len(self.steps) - 1

    def build(self, tokens: Sequence[str], at: int, here: int, depth: int) -> tuple[int, int]:
        while at < len(tokens):
            token = tokens[at]
            if token == "]]":
                break
            if token == "[[":
                inner, at = self.build(tokens, at + 1, here, depth + 1)
                if at >= len(tokens):
                    raise ValueError("an optional region is not closed")
                after = self.state()
                self.free[inner].append(after)
                self.free[here].append(after)
                here = after
            elif token.startswith("{{"):
                after = self.state()
                for _ in range(int(token[2:-2])):
                    self.free[here].append(after)
                    new = self.state()
                    self.any_word[here].append(new)
                    here = new
                self.free[here].append(after)
                here = after
            else:
                new = self.state()
                self.steps[here].setdefault(token.encode(), []).append(new)
                here = new
                self.mandatory += depth == 0
            at += 1
        return here, at

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: Sequence[bytes], at: int) -> int:
        """How many words from ``at`` on the longest accepted run has, else 0."""
        now, longest, i = self.begin, 0, at
        while now and i < len(words):
            word = words[i]
            new = {t for s in now for t in self.steps[s].get(word, ())} | {t for s in now for t in self.any_word[s]}
            now = self.closure(new)
            i += 1
            if self.accepting in now:
                longest = i - at
        return longest


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def make_scan(base=BASE, templates=TEMPLATES):
    """() -> (texts -> one list per field of the scan)."""

    def make():
        machines = [(Automaton(t), label, True) for t, label in base] + [(Automaton(t), label, False) for t, label in templates]
        by_first: dict[bytes, list] = {}
        for machine in machines:
            for word in machine[0].first_words:
                by_first.setdefault(word, []).append(machine)
        firsts = frozenset(by_first)

        def scan(texts):
            rows = []
            for text in texts:
                words = words_of(text)
                places, base_labels, labels, score = [], set(), set(), 0.0
                if not firsts.isdisjoint(words):
                    for i, word in enumerate(words):
                        for machine, label, is_base in by_first.get(word, ()):
                            if n := machine.match(words, i):
                                labels.add(label)
                                score = max(score, machine.mandatory / n)
                                if is_base:
                                    places.append(i)
                                    base_labels.add(label)
                rows.append((
                    len(words), len(places), places[0] if places else None, max(places) if places else None,
                    ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
                ))
            return list(zip(*rows, strict=True)) if rows else [[]] * 7

        return scan

    return make


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_name: str, text_name: str, base=BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id and ``FIELDS``, one row per document."""
    return text_map(docs, F.col(text_name), [F.col(id_name).alias("doc_id")], FIELDS, make_scan(base, templates))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text")


def _pattern(template: str) -> str:
    """A template over text where each word stands between two spaces of its own."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        out += {"[[": "(?:", "]]": ")?"}.get(token) or (f"(?: [^ ]+ ){{0,{token[2:-2]}}}" if token.startswith("{{") else f" {token} ")
    return out


def _matches_sql() -> str:
    parts = []
    for template, label in (*BASE, *TEMPLATES):
        mandatory = Automaton(template).mandatory
        parts.append(f"SELECT doc_id, '{label}' AS label, list_max(list_transform(regexp_extract_all(s, '{_pattern(template)}'), lambda m: {mandatory} / len(string_split(trim(m), '  '))::DOUBLE)) AS score FROM s WHERE regexp_matches(s, '{_pattern(template)}')")
    return " UNION ALL ".join(parts)


def _places_sql() -> str:
    parts = []
    for phrase, label in BASE:
        words = phrase.split()
        stands = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        parts.append(f"SELECT doc_id, '{label}' AS label, i - 1 AS pos FROM p, unnest(range(1, len(w) - {len(words) - 2})) AS r(i) WHERE len(w) >= {len(words)} AND list_contains(w, '{words[-2]}') AND {stands}")
    return " UNION ALL ".join(parts)


#: The scan in DuckDB: base phrases by position, templates as regular expressions.
OP5_SQL = f"""
WITH p AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS s FROM p),
b AS ({_places_sql()}), m AS ({_matches_sql()}),
bg AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
mg AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM m GROUP BY 1)
SELECT p.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM p LEFT JOIN bg USING (doc_id) LEFT JOIN mg USING (doc_id)"""
