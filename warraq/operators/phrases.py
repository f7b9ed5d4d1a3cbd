"""Phrases of style and meaning: literals that allow marks between letters, any blanks between words and a conjunction before them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from warraq.functions.scan import rows_of
from warraq.functions.text import MARKS, WORD
from warraq.operators.sentences import split_sentences

FOUND = "rule_id string, kind string, start long, stop long, suggestion string, confidence double"
MARK = re.compile(f"[{MARKS}]")


@dataclass(frozen=True)
class Phrase:
    """A literal of one word or more, what may stand in its place, and the profiles for which it counts."""

    id: str
    kind: str
    literal: str
    replacements: tuple[str, ...]
    profiles: tuple[str, ...] = ("all",)
    confidence: float = 0.8


@dataclass(frozen=True)
class Pattern:
    """A regular expression that is looked for within each sentence; the replacement may name its groups."""

    id: str
    kind: str
    regex: str
    replacement: str
    confidence: float = 0.97


#: Phrases and patterns of our own.
PHRASES = (
    Phrase("WORDY_FOR", "wordiness", "من أجل", ("لأجل", "لـ")), Phrase("WORDY_MAY", "wordiness", "من الممكن أن", ("قد",)), Phrase("REDUNDANT_EFFORT", "redundancy", "بجد واجتهاد", ("بجد",), ("formal", "academic")),
    Phrase("PASSIVE_DONE_PHRASE", "awkward", "تم تنفيذ", ("نُفذ",), ("academic",)), Phrase("CLICHE_FINAL", "cliche", "لا رجعة فيه", ("نهائي",), ("creative",)), Phrase("WORDY_VERY", "wordiness", "جدا", ()),
)
PATTERNS = (
    Pattern("REDUNDANT_RISE", "redundancy", r"ارتفع\s+إلى\s+(\S+)\s+خلال", r"بلغ \1 خلال"), Pattern("REDUNDANT_MEET", "redundancy", r"نلتقي\s+(هنا|غدا)", r"نجتمع \1"),
    Pattern("CONTRADICTION_FINAL", "contradiction", r"نهائي\s+ولا\s+رجعة", ""),
)


def tolerant(literal: str) -> re.Pattern[str]:
    """The pattern of a literal; an empty one is an error."""
    words = literal.split()
    if not words:
        raise ValueError("a phrase must have a word")
    between = [f"[{MARKS}]*".join(map(re.escape, w)) + f"[{MARKS}]*" for w in words]
    return re.compile(rf"(?<![{WORD}])([وف]?)" + r"\s+".join(between) + rf"(?![{WORD}])")


def matches(docs: DataFrame, phrases: tuple[Phrase, ...] = PHRASES, profiles: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, rule_id, kind, start, stop, suggestion, confidence`` of the phrases of active profiles; a conjunction before a phrase stays before its replacement.

    Replacements that occur twice are taken once, the first is the suggestion. A text without the letters of a phrase's first word is not searched for it.
    """
    active = [(p, tolerant(p.literal), p.literal.split()[0], next(iter(dict.fromkeys(p.replacements)), None)) for p in phrases if "all" in p.profiles or set(p.profiles) & set(profiles)]

    def found(text: str) -> Iterator[tuple]:
        plain = MARK.sub("", text)
        for p, pattern, first, to in active:
            if first in plain:
                for m in pattern.finditer(text):
                    yield p.id, p.kind, m.start(), m.end(), None if to is None else m[1] + to, p.confidence

    return rows_of(docs, found, FOUND)


def in_sentences(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """Matches of patterns that do not reach over the end of a sentence, as matches() gives them."""
    active = [(p, re.compile(p.regex)) for p in patterns]

    def found(text: str) -> Iterator[tuple]:
        spans = None
        for p, pattern in active:
            if not pattern.search(text):
                continue
            spans = split_sentences(text) if spans is None else spans
            for a, b, _ in spans:
                for m in pattern.finditer(text[a:b]):
                    yield p.id, p.kind, a + m.start(), a + m.end(), m.expand(p.replacement) or None, 0.99 if p.kind == "contradiction" else p.confidence

    return rows_of(docs, found, FOUND)
