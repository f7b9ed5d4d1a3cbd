"""Private spans of whole texts: addresses, e-mails and phone numbers; masks of the same length, and what restores them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.scan import rows_of
from warraq.functions.workers import importable
from warraq.operators.spans import drop_overlapping

#: Patterns of private spans, what is cut from the end of an address, and the range masks are taken from.
PATTERNS = {
    "url": re.compile(r"(?:https?://|ftp://|www\.)[^\s<>\[\]{}\"'`]+", re.I),
    "email": re.compile(r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "phone": re.compile(r"(?<![\w@])\+?[0-9٠-٩](?:[\s().\-]?[0-9٠-٩]){6,14}(?![\w@])"),
}
URL_ENDS = ".,،؛؟!?:;)»]}>"
FIRST_MASK, MASKS, MOST = 0xE000, 0x1900, 4096
PRIVATE_USE = re.compile(f"[{chr(FIRST_MASK)}-{chr(FIRST_MASK + MASKS - 1)}]")


def private(text: str) -> list[tuple[str, int, int]]:
    """Disjoint spans ``(kind, start, stop)``: of those that overlap the first, then the longest, then the first kind by name stays."""
    found = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            cut = len(m[0]) - len(m[0].rstrip(URL_ENDS)) if kind == "url" else 0
            if m.end() - cut > m.start():
                found.append((m.start(), cut - len(m[0]), kind))
    out, end = [], 0
    for start, minus, kind in sorted(found):
        if start >= end:
            end = start - minus
            out.append((kind, start, end))
    return out


def mask(text: str) -> tuple[str, list[tuple[str, int, int, str, str]]]:
    """The text with each private span as long a run of a character of its own, and ``(kind, start, stop, original, character)``.

    The character of span i is the first from U+E000 + i on that neither the text nor an earlier span uses. More than 4,096 spans are an error.
    """
    spans = private(text)
    if len(spans) > MOST:
        raise ValueError(f"{len(spans)} private spans, more than {MOST}")
    taken = set(PRIVATE_USE.findall(text)) if spans else set()
    parts, noted, at = [], [], 0
    for i, (kind, start, stop) in enumerate(spans):
        sign = next((c for k in range(MASKS) if (c := chr(FIRST_MASK + (i + k) % MASKS)) not in taken), None)
        if sign is None:
            raise ValueError("no private character is left")
        taken.add(sign)
        parts += [text[at:start], sign * (stop - start)]
        noted.append((kind, start, stop, text[start:stop], sign))
        at = stop
    return "".join([*parts, text[at:]]), noted


def restore(text: str, noted: list[tuple[str, str]]) -> str:
    """A masked text, which may have changed around the masks, with each whole run of a mask as its original; ``(original, character)``."""
    originals = {sign: original for original, sign in noted}
    if not originals:
        return text
    runs = re.compile("|".join(f"{re.escape(sign)}{{{len(original)}}}" for sign, original in originals.items()))
    return runs.sub(lambda m: originals[m[0][0]], text)


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, start, stop`` of every private span, disjoint. A null text has none."""
    return rows_of(docs, lambda text: iter(private(text)), "kind string, start long, stop long")


def masked(docs: DataFrame) -> DataFrame:
    """``doc_id, text, masks``: texts masked at the same length, and what is behind each mask. A null text is an empty one."""

    def found(text: str) -> Iterator[tuple]:
        out, noted = mask(text)
        yield out, [{"kind": k, "start": a, "stop": b, "original": o, "sign": s} for k, a, b, o, s in noted]

    return rows_of(docs, found, "masked string, masks array<struct<kind: string, start: bigint, stop: bigint, original: string, sign: string>>").withColumnRenamed("masked", "text")


def restored(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` of rows of masked(), whatever was done to the text around the masks."""
    importable(rows.sparkSession)

    def run(texts: pd.Series, masks: pd.Series) -> pd.Series:
        return pd.Series([restore(t, [(m["original"], m["sign"]) for m in ms]) for t, ms in zip(texts, masks, strict=True)])

    return rows.select("doc_id", F.pandas_udf(run, "string")("text", "masks").alias("text"))


def logged(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with each private span as ``[REDACTED_KIND]``."""

    def found(text: str) -> Iterator[tuple]:
        parts, at = [], 0
        for kind, start, stop in private(text):
            parts += [text[at:start], f"[REDACTED_{kind.upper()}]"]
            at = stop
        yield ("".join([*parts, text[at:]]),)

    return rows_of(docs, found, "logged string").withColumnRenamed("logged", "text")


def outside(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Matches that overlap no private span of their document."""
    return drop_overlapping(matches, spans(docs))
