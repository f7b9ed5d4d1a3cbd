"""Sentences, and the checks and measures that need them.

Candidates for an end are line ends and runs of terminators with the closers behind them, found by one
pattern. Dots that end nothing, between digits, after a list marker or in an abbreviation, are found by others and taken out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.scan import rows_of, tokens_of

#: What ends a sentence, what closes it, and what may stand before an abbreviation.
TERMINATORS = ".!?؟؛…"
CLOSERS = "\"'»”’)]}"
OPENERS = "([{'\"«،؛:—-"
ABBREVIATIONS = ("د.", "أ.د.", "م.", "أ.", "ص.", "ج.", "هـ.", "ق.م.", "م.م.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "e.g.", "i.e.")
END = re.compile(rf"\n|[{TERMINATORS}]+[{re.escape(CLOSERS)}]*")
DECIMAL = re.compile(r"(?<=[0-9٠-٩])\.(?=[0-9٠-٩])")
#: What stands in a line before its first character that is neither blank nor an end, and the marker.
MARKER = re.compile(rf"^(?:[^\S\n]|[{TERMINATORS}]+[{re.escape(CLOSERS)}]*)*(?:[0-9٠-٩]{{1,3}}|[A-Za-zأ-ي])[^\S\n]*(\.)", re.M)
#: One pattern for each number of dots in an abbreviation, as they may overlap.
SHORT = [re.compile(rf"(?:^|(?<=[\s{re.escape(OPENERS)}]))(?:{'|'.join(re.escape(a[:-1]) for a in ABBREVIATIONS if a.count('.') == n)})(\.)") for n in (1, 2)]
LONG_WORDS = 50


def kept_dots(text: str) -> set[int]:
    """Places of dots that end nothing."""
    if "." not in text:
        return set()
    return {m.start() for m in DECIMAL.finditer(text)} | {m.start(1) for pattern in (MARKER, *SHORT) for m in pattern.finditer(text)}


def split_sentences(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, stop, terminator)`` of each body that is not blank; the terminator is not part of the body."""
    text, out, start = text or "", [], 0
    dots = kept_dots(text)
    for m in END.finditer(text):
        stop = m.start()
        while stop in dots:
            stop += 1
        # A run of which every dot is kept ends nothing.
        if stop == m.end() or text[stop] not in TERMINATORS + "\n":
            continue
        if text[start:stop].strip():
            out.append((start, stop, text[stop : m.end()]))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text), ""))
    return out


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, sent, start, stop, terminator, body``; a text without a word has none."""

    def found(text: str) -> Iterator[tuple]:
        return ((i, a, b, end, text[a:b]) for i, (a, b, end) in enumerate(split_sentences(text)))

    return rows_of(docs, found, "sent int, start int, stop int, terminator string, body string")


def measured(text: str) -> list[list[int]]:
    """Of each sentence: start, stop, words, long words and inner marks. A word belongs to the sentence that begins last before it."""
    spans = split_sentences(text)
    starts = [a for a, _, _ in spans]
    out = [[a, b, 0, 0, sum(map(text[a:b].count, "،؛:("))] for a, b, _ in spans]
    for piece, at, _, kind in tokens_of(text) if spans else ():
        if kind in ("arabic", "latin") and (k := bisect_right(starts, at)):
            out[k - 1][2] += 1
            out[k - 1][3] += len(piece) >= 8
    return out


def heatmap(docs: DataFrame) -> DataFrame:
    """Complexity and clarity of each sentence from its words, inner punctuation and long words, in one pass over each text."""
    rows = rows_of(docs, lambda text: ((i, *x) for i, x in enumerate(measured(text))), "sent int, start int, stop int, words long, long_words long, load int")
    raw = F.greatest(F.lit(0), F.col("words") - 12) * 2.8 + F.col("load") * 7.0 + F.col("long_words") * 1.8
    rows = rows.withColumn("complexity", F.least(F.lit(100.0), raw.cast("double")))
    heat = F.when(F.col("complexity") < 28, "cool").when(F.col("complexity") < 52, "balanced").when(F.col("complexity") < 72, "warm").otherwise("hot")
    return rows.select("doc_id", "sent", "start", "stop", "words", F.round("complexity", 6).alias("complexity"), F.round(100 - F.col("complexity") * 0.72, 6).alias("clarity"), heat.alias("heat"))


def long_sentences(docs: DataFrame, most: int = LONG_WORDS) -> DataFrame:
    """Sentences of more than fifty words; the span is the first forty code points at most."""
    h = heatmap(docs).where(F.col("words") > most)
    return h.select("doc_id", F.lit("STYLE_LONG_SENTENCE").alias("rule_id"), "start", F.least("stop", F.col("start") + 40).alias("stop"), "words")
