"""Rewriting with a budget of edits: up to three variants by mode, with their changes and scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.resources import REWRITES
from warraq.functions.workers import importable

STEPS = {"formal": ("formal",), "concise": ("concise",), "creative": ("creative",), "expand": ("expand",), "academic": ("formal", "academic", "concise")}
DOUBLED = re.compile(r"\b(\w{2,})(?:[ \t]+\1\b)+")


def spaced(text: str) -> str:
    """One blank between words, none before punctuation, one after Arabic commas and colons."""
    text = re.sub(r" ([،؛:,.!?؟])", r"\1", re.sub(r"[ \t]+", " ", text))
    return re.sub(r"([،؛:]) *", r"\1 ", text).strip()


def replaced(text: str, table: tuple[tuple[str, str], ...], budget: int) -> tuple[str, list[str]]:
    """Pairs in order, each from the left, until the budget is spent; the changes as ``old>new``."""
    log: list[str] = []
    for old, new in table:
        n = min(text.count(old), budget - len(log))
        if n > 0:
            text = text.replace(old, new, n)
            log += [f"{old}>{new}"] * n
    return text, log


def variants(text: str | None, mode: str, alternatives: int = 3) -> list[dict]:
    """Variant v may make 3v edits per table (v in the concise part of academic); equal variants are given once, a blank text has none."""
    if mode not in STEPS or not 1 <= alternatives <= 3:
        raise ValueError("mode must be known and alternatives between one and three")
    source, out, seen = (text or "").strip(), [], set()
    for v in range(1, alternatives + 1) if source else ():
        now, changes = source, []
        for step in STEPS[mode]:
            now, log = replaced(now, REWRITES[step], v if (mode, step) == ("academic", "concise") else 3 * v)
            changes += log
        if mode == "concise":
            now, n = DOUBLED.subn(r"\1", now)
            changes += ["doubled"] * min(n, 3 * v)
        now = spaced(now)
        if now in seen:
            continue
        seen.add(now)
        ratio = min(1.0, abs(len(source) - len(now)) / len(source))
        out.append({
            "variant": v, "text": now, "changes": len(changes), "log": changes, "brevity": round(max(-1.0, min(1.0, (len(source) - len(now)) / len(source))), 6),
            "meaning": round(max(0.72, 0.99 - 0.34 * ratio - 0.006 * len(changes)), 6), "confidence": round(max(0.62, min(0.97, 0.90 - 0.15 * ratio + 0.005 * min(len(changes), 8))), 6),
        })
    return out


def rewrite(docs: DataFrame, mode: str, alternatives: int = 3) -> DataFrame:
    """``doc_id, variant, text, changes, log, brevity, meaning, confidence`` in Arrow batches; the budget makes replacement sequential."""
    importable(docs.sparkSession)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([variants(x, mode, alternatives) for x in s])

    of = F.pandas_udf(run, "array<struct<variant: int, text: string, changes: int, log: array<string>, brevity: double, meaning: double, confidence: double>>")
    return docs.select("doc_id", F.explode(of(F.coalesce("text", F.lit("")))).alias("v")).select("doc_id", "v.*")
