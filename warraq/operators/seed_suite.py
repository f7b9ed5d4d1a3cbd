"""Evaluation by rule, start and length, and proof of distilled rules on their own examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions.text import WORD


def labels(cases: DataFrame) -> DataFrame:
    """Spans of ``cases(doc_id, text, expected array<struct<rule_id, target>>)``.

    The k-th entry of a target is its k-th occurrence that overlaps none before; a target that is not there is an error.
    """
    rows = cases.select("doc_id", "text", F.posexplode("expected").alias("nth", "e")).select("doc_id", "text", "nth", "e.*")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "target").orderBy("nth")))
    before = F.array_join(F.slice(F.split("text", F.concat(F.lit(r"\Q"), F.col("target"), F.lit(r"\E")), -1), F.lit(1), F.col("k")), "")
    there = F.size(F.split("text", F.concat(F.lit(r"\Q"), F.col("target"), F.lit(r"\E")), -1)) > F.col("k")
    size = F.char_length("target")
    start = F.char_length(before) + (F.col("k") - 1) * size
    start = F.when(there, start).otherwise(F.raise_error(F.concat(F.lit("target not found: "), F.col("target"))))
    return rows.select("doc_id", "rule_id", start.cast("long").alias("start"), (start + size).cast("long").alias("stop")).distinct()


def evaluate(expected: DataFrame, actual: DataFrame, words: DataFrame) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, F0.5, and false positives a thousand of ``words(words)``."""
    key = ["doc_id", "rule_id", "start", "stop"]
    both = expected.select(*key, F.lit(True).alias("e")).join(actual.select(*key).distinct().withColumn("a", F.lit(True)), key, "full_outer")
    n = both.agg(F.count_if(F.col("e") & F.col("a")).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    rows = n.crossJoin(F.broadcast(words.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))))  # one row each
    six = lambda x: F.round(x.cast("double"), 6)
    f = F.when(p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)
    per = F.when(F.col("words") > 0, fp * 1000 / F.col("words")).otherwise(0.0)
    return rows.select("tp", "fp", "fn", "words", six(p).alias("p"), six(r).alias("r"), six(f).alias("f05"), six(per).alias("fp_per_1000"))


def verified(candidates: DataFrame) -> DataFrame:
    """Candidates ``bad, good, example`` whose pattern, as whole words, is in the example and no longer in its correction."""
    edge = lambda a, b: F.concat(F.lit(rf"(?:{a}|[^{WORD}])"), F.col("bad"), F.lit(rf"(?:{b}|[^{WORD}])"))
    fires = lambda text: F.rlike(text, edge(r"\A", r"\z"))
    fixed = F.replace("example", F.col("bad"), F.col("good"))
    return candidates.withColumn("verified", fires(F.col("example")) & ~fires(fixed))
