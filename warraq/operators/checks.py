"""Built-in checks, each a pass over one text. All give ``doc_id, rule_id, start, stop`` and a suggestion."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from warraq.functions.resources import FEMININE_COUNTED, MASCULINE_COUNTED, MASCULINE_NUMERALS
from warraq.functions.scan import rows_of, tokens_of
from warraq.functions.text import LETTERS, STROKE, WORD

COLUMNS = ("doc_id", "rule_id", "start", "stop", "suggestion")
FOUND = "rule_id string, start long, stop long, suggestion string"
Found = Iterator[tuple[str, int, int, str]]
Tokens = list[tuple[str, int, int, str]]
#: Marks of the Latin script, their Arabic counterparts, and the rules for them.
LATIN_MARKS = {",": ("،", "PUNCT_LATIN_COMMA"), "?": ("؟", "PUNCT_LATIN_QMARK"), ";": ("؛", "PUNCT_LATIN_SEMI")}
#: Letters of dialects and the standard ones for them.
DIALECT_LETTERS = str.maketrans("چگپژ", "جكبز")
AFTER_LETTER = re.compile(rf"(?<=[{LETTERS}])(?:[,?;]|\s+[?;])")
BLANK_BEFORE = re.compile(r"[ \t]+([،؛؟!.,:])")
STROKES, LETTER_RUN, WORD_RUN = re.compile(f"{STROKE}+"), re.compile(f"[{LETTERS}]+"), re.compile(f"[{WORD}]+")
#: Numeral and noun that must not agree: the rule and the numeral in its place.
MISMATCHES = {(m, n): ("AGREEMENT_NUM_FEM_NOUN", f) for m, f in MASCULINE_NUMERALS for n in FEMININE_COUNTED}
MISMATCHES |= {(f, n): ("AGREEMENT_NUM_MASC_NOUN", m) for m, f in MASCULINE_NUMERALS for n in MASCULINE_COUNTED}


def repeated_words(text: str, tokens: Tokens) -> Found:
    """An Arabic word of two letters or more that is written again after nothing but white space."""
    for (piece, start, _, kind), (_, _, _, between), (again, _, stop, _) in zip(tokens, tokens[1:], tokens[2:]):
        if kind == "arabic" and len(piece) > 1 and between == "whitespace" and again == piece:
            yield "STYLE_REPEATED_WORD", start, stop, piece


def latin_punctuation(text: str, tokens: Tokens) -> Found:
    """Latin comma, question mark or semicolon after an Arabic letter; blanks before the latter two belong to the span."""
    for m in AFTER_LETTER.finditer(text):
        to, rule = LATIN_MARKS[m[0][-1]]
        yield rule, m.start(), m.end(), to


def space_before(text: str, tokens: Tokens) -> Found:
    """Blanks or tabs before a punctuation mark; the mark belongs to the span."""
    return (("PUNCT_SPACE_BEFORE", m.start(), m.end(), m[1]) for m in BLANK_BEFORE.finditer(text))


def elongations(text: str, tokens: Tokens) -> Found:
    return (("STYLE_TATWEEL", m.start(), m.end(), "") for m in STROKES.finditer(text))


def dialect_letters(text: str, tokens: Tokens) -> Found:
    for m in LETTER_RUN.finditer(text):
        if (to := m[0].translate(DIALECT_LETTERS)) != m[0]:
            yield "DIALECT_LETTERS", m.start(), m.end(), to


def number_agreement(text: str, tokens: Tokens) -> Found:
    """Numerals three to ten that agree with the counted noun where they must differ from it."""
    runs = list(WORD_RUN.finditer(text))
    for a, b in zip(runs, runs[1:]):
        if (hit := MISMATCHES.get((a[0], b[0]))) and text[a.end() : b.start()].isspace():
            yield hit[0], a.start(), a.end(), hit[1]


CHECKS: dict[str, Callable[[str, Tokens], Found]] = {
    "repeated_words": repeated_words,
    "latin_punct": latin_punctuation,
    "space_before_punct": space_before,
    "tatweel": elongations,
    "dialect_letters": dialect_letters,
    "number_agreement": number_agreement,
}


def all_of(text: str, names: tuple[str, ...] = tuple(CHECKS)) -> Found:
    """Matches of the named checks, by one tokenisation."""
    tokens = list(tokens_of(text))
    for name in names:
        yield from CHECKS[name](text, tokens)


def all_checks(docs: DataFrame, names: tuple[str, ...] = tuple(CHECKS)) -> DataFrame:
    return rows_of(docs, lambda text: all_of(text, names), FOUND).select(*COLUMNS)
