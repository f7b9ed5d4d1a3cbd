"""Choosing among the readings of an ambiguous word by what stands around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions.resources import SENSE_WEIGHTS
from warraq.operators.morphology import analyses

TEMPERATURE, PRIOR = 0.82, 0.08
AMBIGUOUS_SURE, AMBIGUOUS_MARGIN = 0.86, 0.08
ACCEPT, ACCEPT_MARGIN = 0.78, 0.18


def surroundings(words: DataFrame) -> DataFrame:
    """Words of sentence_words() with ``features``: forms and parts of speech up to two places away, and the ends of the stretch."""
    by = Window.partitionBy("doc_id", "sent").orderBy("place")
    near = []
    for side, shift in (("left", F.lag), ("right", F.lead)):
        for k in (1, 2):
            near += [F.concat(F.lit(f"{side}{k}:"), shift("form", k).over(by)), F.concat(F.lit(f"{side}_pos{k}:"), shift("pos", k).over(by))]
    edges = [F.when(F.col("place") == 1, F.lit("bos")), F.when(F.lead("form").over(by).isNull(), F.lit("eos")), F.when(F.lead("form").over(by).startswith("ال"), F.lit("next_definite")), F.lit("bias")]
    return words.withColumn("features", F.array_compact(F.array(*near, *edges)))


def scored(words: DataFrame, lexicon: DataFrame, every: bool = False) -> DataFrame:
    """``doc_id, idx, form, pos, lemma, prob``: readings of ambiguous words (or of every word of two readings or more).

    Readings are the surest analysis of each part of speech and lemma. A reading's score is the sum of the
    weights of its features and 0.08 times the log of its confidence; probabilities are a softmax of scores.
    """
    a = analyses(words.select("form").distinct(), lexicon).groupBy("form", "pos", "lemma").agg(F.max("confidence").alias("confidence"))
    of = Window.partitionBy("form")
    ordered = of.orderBy(F.desc("confidence"), "pos", "lemma")
    a = a.withColumns({"n": F.count(F.lit(1)).over(of), "top": F.max("confidence").over(of), "nth": F.row_number().over(ordered)})
    second = F.max(F.when(F.col("nth") == 2, F.col("confidence"))).over(of)
    a = a.withColumn("gap", F.round(F.col("top") - second, 6)).where("n >= 2").drop("nth", "top")
    rows = surroundings(words).select("doc_id", "idx", "form", "features", "sure").join(a, "form")
    if not every:
        rows = rows.where((F.coalesce("sure", F.lit(0.0)) < AMBIGUOUS_SURE) | (F.col("gap") <= AMBIGUOUS_MARGIN))
    # the weights are a small fixed table, so they are a literal of the plan
    weights = F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(f).alias("feature"), F.lit(round(w * 1000)).cast("long").alias("w")) for p, f, w in SENSE_WEIGHTS))
    fit = F.aggregate(F.filter(weights, lambda x: (x["pos"] == F.col("pos")) & F.array_contains(F.col("features"), x["feature"])), F.lit(0).cast("long"), lambda acc, x: acc + x["w"])
    rows = rows.withColumn("score", fit / 1000 + F.log("confidence") * PRIOR)
    by = Window.partitionBy("doc_id", "idx")
    e = F.exp((F.col("score") - F.max("score").over(by)) / TEMPERATURE)
    rows = rows.withColumn("e", e).withColumn("prob", F.round(F.col("e") / F.sum("e").over(by), 5))
    return rows.select("doc_id", "idx", "form", "pos", "lemma", "prob")


def chosen(readings: DataFrame) -> DataFrame:
    """The likeliest reading of each word and whether it is likely and clear enough to be taken."""
    order = Window.partitionBy("doc_id", "idx").orderBy(F.desc("prob"), "pos", "lemma")
    rows = readings.withColumns({"rank": F.row_number().over(order), "margin": F.round(F.col("prob") - F.lead("prob").over(order), 5)}).where("rank = 1")
    return rows.select("doc_id", "idx", "form", "pos", "lemma", "prob", "margin", ((F.col("prob") >= ACCEPT) & (F.col("margin") >= ACCEPT_MARGIN)).alias("accepted"))


def student_rows(readings: DataFrame, least: float = 0.999) -> DataFrame:
    """One training row per word: its labels in order, and the likeliest only where the teacher is as good as certain."""
    label = F.concat_ws(":", "pos", "lemma")
    per = readings.withColumn("label", label).groupBy("doc_id", "idx").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.max(F.struct("prob", F.col("label"))).alias("m"))
    return per.select("doc_id", "idx", F.array_join("labels", "|").alias("labels"), F.when(F.col("m.prob") >= least, F.col("m.label")).alias("selected"))
