"""Evaluation of a checker against gold annotations, and agreement of reviewers.

Spans are equal in (doc_id, start, stop, category); of repeated ones the last list of replacements by order counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.operators.analytics import six
from warraq.operators.records import f_beta, kappa, ratio

KEY = ["doc_id", "start", "stop", "category"]
#: Categories that a scope holds; ``all`` holds every one.
SCOPES = {
    "all": None, "mechanical": ("spelling", "grammar", "punctuation"), "style": ("style",), "dialect": ("dialect",), "neural": ("neural_suggestion",),
    "semantics": ("semantics", "consistency"), "diacritics": ("diacritics",),
}


def _once(rows: DataFrame, column: str) -> DataFrame:
    """One row per span; of repeated ones the greatest list."""
    return rows.groupBy(*KEY).agg(F.max(F.coalesce(column, F.array().cast("array<string>"))).alias(column))


def _n(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def in_scopes(rows: DataFrame, scopes: tuple[str, ...]) -> DataFrame:
    """Each row once for every scope that holds its category."""
    names = F.array(*(F.when(F.lit(True) if SCOPES[s] is None else F.col("category").isin(*SCOPES[s]), F.lit(s)) for s in scopes))
    return rows.withColumn("scope", F.explode(F.filter(names, lambda x: x.isNotNull())))


def report(cases: DataFrame, gold: DataFrame, found: DataFrame, scopes: tuple[str, ...] = ("all",)) -> DataFrame:
    """Counts and rates by scope, from one full outer join of ``gold(.., accepted)`` and ``found(.., replacements)`` over all ``cases(doc_id, words)``.

    Spans; corrections, where a replacement among the accepted ones counts, or a span whose gold accepts anything; documents with any error
    against documents with any match; documents with exactly the gold spans; mean reciprocal rank of the first accepted
    replacement; false matches per thousand words. Where nothing was there to find a rate is 1.
    """
    both = _once(gold, "accepted").withColumn("g", F.lit(True)).join(_once(found, "replacements").withColumn("p", F.lit(True)), KEY, "full_outer")
    both = in_scopes(both.withColumns({"g": F.coalesce("g", F.lit(False)), "p": F.coalesce("p", F.lit(False))}), scopes)
    ranks = F.array_min(F.filter(F.transform("accepted", lambda a: F.array_position("replacements", a)), lambda p: p > 0))
    hit, open_ = F.col("g") & F.col("p"), F.size("accepted") == 0
    rows = both.withColumns({"hit": hit, "rank": F.when(hit & ~open_, ranks), "ranked": hit & ~open_})
    right = F.col("hit") & ((F.size("accepted") == 0) | F.col("rank").isNotNull())
    per = rows.groupBy("scope", "doc_id").agg(
        _n(F.col("hit")).alias("tp"), _n(F.col("p") & ~F.col("g")).alias("fp"), _n(F.col("g") & ~F.col("p")).alias("fn"), _n(right).alias("right"), _n(F.col("ranked")).alias("ranked"),
        F.sum(F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)) * 1e9).cast("long") * F.col("ranked").cast("long")).alias("mrr"),
    )
    any_gold, any_found = F.col("tp") + F.col("fn") > 0, F.col("tp") + F.col("fp") > 0
    names = cases.sparkSession.createDataFrame([(s,) for s in scopes], "scope string")
    total = cases.agg(F.count(F.lit(1)).alias("cases"), F.sum("words").alias("words"))
    sums = per.groupBy("scope").agg(
        *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "right", "ranked", "mrr")), _n(any_gold & any_found).alias("d_tp"), _n(~any_gold & any_found).alias("d_fp"),
        _n(any_gold & ~any_found).alias("d_fn"), _n((F.col("fp") > 0) | (F.col("fn") > 0)).alias("inexact"),
    )
    rows = names.join(sums, "scope", "left").na.fill(0).crossJoin(F.broadcast(total))
    c = F.col
    out = [c("scope"), *(c(x).cast("long").alias(x) for x in ("cases", "words", "tp", "fp", "fn"))]

    def rates(prefix: str, tp: Column, fp: Column, fn: Column) -> list[Column]:
        p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
        return [six(p).alias(f"{prefix}precision"), six(r).alias(f"{prefix}recall"), six(f_beta(p, r)).alias(f"{prefix}f05")]

    wrong = c("tp") - c("right")
    out += rates("", c("tp"), c("fp"), c("fn")) + rates("correction_", c("right"), c("fp") + wrong, c("fn") + wrong) + rates("sentence_", c("d_tp"), c("d_fp"), c("d_fn"))
    out += [six((c("cases") - c("inexact")) / c("cases")).alias("exact"), six(F.coalesce(F.try_divide(c("mrr") / 1e9, c("ranked")), F.lit(1.0))).alias("mrr"), six(ratio(c("fp") * 1000, c("words"))).alias("fp_per_1000")]
    return rows.select(*out)


def agreement(cases: DataFrame, reviews: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two reviewers over ``cases(doc_id)``: kappa of whether a case has an error, F1 of spans, of spans that both
    have the share that accept a replacement in common, and of cases the share with the same annotations.

    ``reviews(annotator, doc_id, start, stop, category, accepted)`` is joined with itself by span.
    """
    side = lambda who: _once(reviews.where(F.col("annotator") == who), "accepted")
    left, right = side(a).withColumnRenamed("accepted", "x"), side(b).withColumnRenamed("accepted", "y")
    both = left.join(right, KEY, "full_outer")
    shared = F.col("x").isNotNull() & F.col("y").isNotNull()
    same = F.arrays_overlap("x", "y") | ((F.size("x") == 0) & (F.size("y") == 0))
    per = both.groupBy("doc_id").agg(
        _n(shared).alias("tp"), _n(F.col("x").isNull()).alias("fp"), _n(F.col("y").isNull()).alias("fn"), _n(shared & same).alias("same"),
        _n(shared & (F.col("x") == F.col("y"))).alias("equal"), _n(F.col("x").isNotNull()).alias("nx"), _n(F.col("y").isNotNull()).alias("ny"),
    )
    rows = cases.select("doc_id").join(per, "doc_id", "left").na.fill(0).withColumns({"a": (F.col("nx") > 0).cast("int"), "b": (F.col("ny") > 0).cast("int")})
    exact = (F.col("equal") == F.col("nx")) & (F.col("equal") == F.col("ny"))
    sums = rows.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "same")), _n(exact).alias("exact"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    judged = kappa(rows.withColumn("all", F.lit(1)), "all").drop("all")
    out = judged.crossJoin(F.broadcast(sums))
    return out.select("n", "observed", "kappa", six(f_beta(p, r, 1.0)).alias("span_f1"), six(ratio(F.col("same"), F.col("tp"))).alias("correction_agreement"), six(F.col("exact") / F.col("n")).alias("exact_agreement"))
