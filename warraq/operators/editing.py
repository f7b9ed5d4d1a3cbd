"""Texts under edit: replay of ranged changes, and checks of the sentences about an edit alone."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.functions.workers import importable
from warraq.operators.sentences import split_sentences


def replay(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Each text after its edits ``doc_id, version, start, stop, text`` in order of version; no start replaces the whole text.

    A fold within the row of a document, so its edits must fit one row; documents are independent.
    """
    item = F.struct("version", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.coalesce("text", F.lit("")).alias("put"))
    per = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("e"), F.max("version").alias("version"))
    step = lambda acc, e: F.when(e["start"].isNull(), e["put"]).otherwise(F.concat(F.substring(acc, F.lit(1), e["start"]), e["put"], F.substring(acc, e["stop"] + 1, F.char_length(acc))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("base")).join(per, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.aggregate("e", F.col("base"), step), F.col("base")).alias("text"), F.coalesce("version", F.lit(0)).alias("version"))


def edited_window(old: str, new: str, around: int = 1) -> tuple[int, int, int]:
    """``(start, end in old, end in new)`` of the sentences an edit touches and ``around`` more on either side.

    Borders are starts of sentences that both texts have. A text with a code fence is one window, as a
    fence may pair with another one anywhere.
    """
    if "```" in old or "```" in new:
        return 0, len(old), len(new)
    head = len(commonprefix((old, new)))
    most = min(len(old), len(new)) - head
    tail = len(commonprefix((old[::-1][:most], new[::-1][:most])))
    a = [s for s, _, _ in split_sentences(old)]
    b = [s for s, _, _ in split_sentences(new)]
    shared = sorted(set(a) & set(b))
    k = bisect_right(shared, max(head - 1, 0)) - 1 - around
    start = shared[k] if k >= 0 else 0
    delta = len(new) - len(old)
    ends = sorted({x for x in a if x > len(old) - tail} & {x - delta for x in b})
    k = bisect_left(ends, len(old) - tail + 1) + around
    end = ends[k] if k < len(ends) else len(old)
    return start, end, end + delta


def recheck(old: DataFrame, new: DataFrame, matches: DataFrame, check: Callable[[DataFrame], DataFrame], around: int = 1) -> DataFrame:
    """Matches of the new texts: those of ``matches`` outside each window, shifted, and what ``check`` finds inside.

    ``check`` takes ``doc_id, text`` and returns matches with start and stop; it must look no further than a sentence.
    Documents without an old text are checked whole, and unchanged ones not at all.
    """
    importable(old.sparkSession)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in parts:
            yield pd.DataFrame([edited_window(p, q, around) for p, q in zip(x, y, strict=True)], columns=["a", "was", "now"])

    window = F.pandas_udf(run, "a int, was int, now int")
    text = lambda c: F.coalesce(c, F.lit(""))
    both = new.select("doc_id", text(F.col("text")).alias("text")).join(old.select("doc_id", text(F.col("text")).alias("before")), "doc_id", "left")
    changed = both.where("before is null or before <> text").withColumn("before", text(F.col("before")))
    spans = changed.withColumn("w", window("before", "text")).select("doc_id", "text", "w.*")
    fresh = check(spans.select("doc_id", F.substring("text", F.col("a") + 1, F.col("now") - F.col("a")).alias("text")))
    fresh = fresh.join(spans.select("doc_id", "a"), "doc_id").withColumns({"start": F.col("start") + F.col("a"), "stop": F.col("stop") + F.col("a")}).drop("a")
    kept = matches.join(new.select("doc_id"), "doc_id", "left_semi").join(spans.select("doc_id", "a", "was", "now"), "doc_id", "left").where("a is null or start < a or stop > was")
    shift = F.when(F.col("a").isNull() | (F.col("start") < F.col("a")), 0).otherwise(F.col("now") - F.col("was"))
    kept = kept.withColumns({"start": F.col("start") + shift, "stop": F.col("stop") + shift}).drop("a", "was", "now")
    return kept.unionByName(fresh.select(*kept.columns))
