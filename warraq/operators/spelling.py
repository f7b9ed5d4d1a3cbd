"""Spelling: weighted edit distance and ranked suggestions for distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions.text import normalize, tokens
from warraq.functions.workers import importable
from warraq.operators import morphology

#: Letters that are easily taken for each other, by group, and their costs.
CONFUSED = ("اأإآٱ", "يىئ", "هة", "وؤ", "ءئؤ")
NEAR = (("ض", "ص"), ("ذ", "ز"), ("ث", "ت"), ("ظ", "ض"), ("د", "ذ"), ("ق", "ف"))
CONFUSION, NEARNESS, HAMZA, DOUBLED, SWAP = 0.18, 0.55, 0.35, 0.55, 0.75
HAMZAS = frozenset("ءأإآؤئ")
#: Morphological confidence of a word that is right.
ACCEPTED = 0.72


def _substitution(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if any(a in g and b in g for g in CONFUSED):
        return CONFUSION
    return NEARNESS if (a, b) in NEAR or (b, a) in NEAR else 1.0


def _step(word: str, i: int) -> float:
    """Cost of the letter i that only one of the two words has."""
    if word[i] in HAMZAS:
        return HAMZA
    return DOUBLED if word[i] in (word[i - 1 : i], word[i + 1 : i + 2]) else 1.0


def distance(a: str, b: str) -> float:
    """Edit distance with swaps of neighbours; confused letters cost less, the border rows count whole letters."""
    before: list[float] = []
    last = [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [float(i)]
        for j in range(1, len(b) + 1):
            best = min(last[j - 1] + _substitution(a[i - 1], b[j - 1]), last[j] + _step(a, i - 1), row[j - 1] + _step(b, j - 1))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != b[j - 1]:
                best = min(best, before[j - 2] + SWAP)
            row.append(best)
        before, last = last, row
    return last[-1]


def deletions(forms: DataFrame, column: str) -> DataFrame:
    """Each form under itself, each of its one-letter deletions, and its skeleton of unconfused letters."""
    form = F.col(column)
    cut = F.transform(F.sequence(F.lit(1), F.char_length(form)), lambda i: F.concat(F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, F.char_length(form))))
    bare = F.translate(form, "أإآٱىئةؤ", "اااايههو")
    return forms.select("*", F.explode(F.array_distinct(F.concat(F.array(form, bare), cut))).alias("key"))


def suggestions(docs: DataFrame, lexicon: DataFrame | None = None, most: int = 5) -> DataFrame:
    """For words that the lexicon does not accept, up to five near words: accepted ones, and commoner ones of the corpus.

    A word is accepted if its best morphological confidence is 0.72 or more; without a lexicon none
    is. How often a word is used never makes it right, as slips are repeated too. Words are compared
    by equal deletion keys, so only near words meet; distances are taken for distinct pairs, up to
    1.05. Ranked by 2.9 times the distance less 0.16 times the log of the frequency relative to the
    word's own, then the word.
    """
    importable(docs.sparkSession)
    words = tokens(docs).where("kind = 'arabic'").select(normalize(F.col("piece"), "lookup").alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.char_length("form") >= 3)
    if lexicon is None:
        judged = words.withColumn("accepted", F.lit(False))
    else:
        sure = morphology.analyses(words, lexicon).where(F.col("confidence") >= ACCEPTED).select("form").distinct().withColumn("accepted", F.lit(True))
        judged = words.join(sure, "form", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    checked = deletions(judged.where("not accepted").select("form", F.col("n").alias("own")), "form")
    others = deletions(judged.select(F.col("form").alias("candidate"), F.col("n").alias("frequency"), "accepted"), "candidate")
    pairs = checked.join(others, "key").where("form <> candidate and (accepted or frequency > own)").select("form", "own", "candidate", "frequency").distinct()

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([distance(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    near = pairs.withColumn("distance", F.pandas_udf(run, "double")("form", "candidate")).where("distance <= 1.05")
    score = F.round(2.9 * F.col("distance") - 0.16 * F.log1p(F.col("frequency") / F.col("own")), 6)
    rank = F.row_number().over(Window.partitionBy("form").orderBy("score", "candidate"))
    return near.withColumn("score", score).drop("own").withColumn("rank", rank).where(F.col("rank") <= most)


def decisions(suggested: DataFrame, sure: DataFrame, margin: float = 0.28, near_margin: float = 0.12) -> DataFrame:
    """Which words of suggestions() are wrong: ``form, candidate, confidence, reason``.

    ``sure(form, confidence)`` holds the best morphological confidence of forms: a word of 0.72 or more
    is right, and a candidate's counts in its favour. Words with letters of dialects are left alone.
    """
    by = F.struct("distance", "score", "candidate", "frequency")
    per = suggested.groupBy("form").agg(F.max(F.when(F.col("rank") == 1, by)).alias("best"), F.max(F.when(F.col("rank") == 2, by)).alias("second"))
    own = sure.groupBy("form").agg(F.max("confidence").alias("own"))
    its = own.withColumnRenamed("form", "candidate").withColumnRenamed("own", "its")
    rows = per.join(own, "form", "left").withColumn("candidate", F.col("best.candidate")).join(its, "candidate", "left")
    d, gap = F.col("best.distance"), F.col("second.score") - F.col("best.score")
    value = 0.58 + F.greatest(F.lit(0.0), 1 - d / 1.2) * 0.20 + F.least(F.lit(1.0), F.coalesce(gap / 1.2, F.lit(1.0))) * 0.10 + F.least(F.lit(1.0), F.log1p("best.frequency") / 11) * 0.06 + F.coalesce("its", F.lit(0.0)) * 0.06
    close = (d > 0.25) & (F.abs(F.col("second.distance") - d) <= 0.30)
    thin = gap < F.when(d <= 0.25, near_margin).otherwise(margin)
    reason = F.when(F.col("form").rlike("[چگپژڤ]"), "dialect_letter").when(F.col("own") >= ACCEPTED, "known_form").when(F.coalesce(close | thin, F.lit(False)), "ambiguous").when(F.col("confidence") < 0.81, "low_confidence").otherwise("corrected")
    return rows.withColumn("confidence", F.round(F.least(F.lit(0.995), value), 6)).select("form", "candidate", "confidence", reason.alias("reason"))
