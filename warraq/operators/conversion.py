"""Standard forms of dialect words, and final marks from cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions import resources as R
from warraq.functions.text import MARKS, normalize, tokens

LEAST = 0.76


def to_standard(docs: DataFrame) -> DataFrame:
    """Matches for spans.resolve(): single words, and a word of wanting with the verb behind it, which wins over its parts.

    Between the two of a pair stands white space only. The word lists are small and fixed, so they are broadcast.
    """
    spark = docs.sparkSession
    order = Window.partitionBy("doc_id").orderBy("idx")
    t = tokens(docs).withColumn("form", normalize(F.col("piece"), "lookup"))
    t = t.withColumns({"gap": F.lead("kind", 1).over(order), "verb": F.lead("form", 2).over(order), "verb_kind": F.lead("kind", 2).over(order), "verb_stop": F.lead("stop", 2).over(order)}).where("kind = 'arabic'")
    words = F.broadcast(spark.createDataFrame([r for r in R.MSA_FORMS if r[2] >= LEAST], "form string, suggestion string, confidence double"))
    wants = F.broadcast(spark.createDataFrame(R.DESIRE_FORMS, "form string, want string"))
    fixed = lambda rule, priority: [F.lit(rule).alias("rule_id"), F.lit("hint").alias("severity"), F.lit(priority).alias("priority")]
    single = t.join(words, "form").select("doc_id", "start", "stop", "suggestion", "confidence", *fixed("DIALECT_WORD", 45))
    verb = (F.col("gap") == "whitespace") & (F.col("verb_kind") == "arabic") & (F.char_length("verb") >= 4) & F.substring("verb", 1, 1).isin("ي", "ت", "ن", "أ")
    pair = t.where(verb).join(wants, "form").select("doc_id", "start", F.col("verb_stop").alias("stop"), F.concat("want", F.lit(" أن "), "verb").alias("suggestion"), F.lit(0.9).alias("confidence"), *fixed("DIALECT_DESIRE", 60))
    return single.unionByName(pair)


def settled(cases: DataFrame) -> DataFrame:
    """Cases where one that follows its head has the head's: ``doc_id, dependent, case``; null where the head has none."""
    head = cases.where("case <> 'follows'").select("doc_id", F.col("dependent").alias("head"), F.col("case").alias("of_head"))
    return cases.join(head, ["doc_id", "head"], "left").select("doc_id", "dependent", F.when(F.col("case") == "follows", F.col("of_head")).otherwise(F.col("case")).alias("case"))


def marked(words: DataFrame, cases: DataFrame) -> DataFrame:
    """Singular words with the final mark of their case; a mark that is there is replaced. Words that end in a long vowel keep theirs."""
    pairs = {case: (closed, opened) for case, closed, opened in R.ENDINGS}
    pick = lambda k: F.create_map(*[F.lit(x) for c, v in pairs.items() for x in (c, v[k])])[F.col("case")]
    bare = F.regexp_replace("piece", f"[{MARKS}]+$", "")
    rows = words.join(cases.withColumnRenamed("dependent", "idx"), ["doc_id", "idx"]).where((F.col("number") == "singular") & F.col("case").isNotNull() & ~F.substring(bare, -1, 1).isin("ا", "ى", "ي", "و"))
    return rows.select("doc_id", "idx", "piece", "case", F.concat(bare, F.when(F.col("definite"), pick(0)).otherwise(pick(1))).alias("marked"))


def mark_suggestions(words: DataFrame, cases: DataFrame, least: float = 0.55) -> DataFrame:
    """Matches ``doc_id, rule_id, start, stop, suggestion, confidence`` for words whose final mark is missing or another, where the case is sure enough.

    ``cases`` as syntax.cases() gives them.
    """
    sure = cases.select("doc_id", F.col("dependent").alias("idx"), "confidence")
    rows = marked(words, settled(cases)).where("marked <> piece").join(sure, ["doc_id", "idx"]).where(F.col("confidence") >= least)
    return rows.join(words.select("doc_id", "idx", "start", "stop"), ["doc_id", "idx"]).select("doc_id", F.lit("DIACRITICS_CASE").alias("rule_id"), "start", "stop", F.col("marked").alias("suggestion"), "confidence")
