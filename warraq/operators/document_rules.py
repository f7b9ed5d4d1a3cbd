"""Rules on whole documents, suppression and correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions.text import normalize


def consistency(hits: DataFrame, preferred: dict[str, str]) -> DataFrame:
    """Occurrences that are not the preferred variant, in documents that use two variants of a rule or more.

    ``hits(doc_id, rule_id, start, stop, surface)``.
    """
    seen = F.size(F.collect_set("surface").over(Window.partitionBy("doc_id", "rule_id")))
    best = F.create_map(*[F.lit(x) for kv in preferred.items() for x in kv])[F.col("rule_id")]
    return hits.withColumn("variants", seen).where((F.col("variants") >= 2) & (F.col("surface") != F.coalesce(best, F.lit("")))).drop("variants")


def occurrence(hits: DataFrame, least: int = 2, first_only: bool = True) -> DataFrame:
    """Hits of rules that fire ``least`` times or more in a document, the first or all."""
    by = Window.partitionBy("doc_id", "rule_id")
    rows = hits.withColumns({"n": F.count(F.lit(1)).over(by), "nth": F.row_number().over(by.orderBy("start", "stop"))}).where(F.col("n") >= least)
    return (rows.where("nth = 1") if first_only else rows).drop("nth")


def line_of(text: Column, offset: Column) -> Column:
    """Line number from one of an offset in code points."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def suppress(matches: DataFrame, docs: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Matches that no row of ``suppressions(doc_id, kind, value)`` covers: document, rule, word or line."""
    rows = matches.join(docs.select("doc_id", "text"), "doc_id")
    word = normalize(F.substring("text", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int")), "lookup")
    rows = rows.withColumns({"_word": word, "_line": line_of(F.col("text"), F.col("start")).cast("string")})
    s = suppressions.select(F.col("doc_id").alias("_d"), "kind", F.when(F.col("kind") == "word", normalize(F.col("value"), "lookup")).otherwise(F.col("value")).alias("value"))
    hit = (F.col("kind") == "document") | ((F.col("kind") == "rule") & (F.col("value") == F.col("rule_id"))) | ((F.col("kind") == "word") & (F.col("value") == F.col("_word"))) | ((F.col("kind") == "line") & (F.col("value") == F.col("_line")))
    return rows.join(s, (F.col("doc_id") == F.col("_d")) & hit, "left_anti").select(*matches.columns)


def correct(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts with disjoint edits ``doc_id, start, stop, suggestion`` applied at their original offsets."""
    item = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "suggestion")
    per = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    rows = docs.join(per, "doc_id", "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, e: F.struct(e["stop"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, e["start"] - acc["at"]), e["suggestion"]).alias("out"))
    done = F.aggregate("e", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    return rows.select("doc_id", F.coalesce(done, F.col("text")).alias("text"))


def reciprocal_rank(cases: DataFrame) -> DataFrame:
    """Mean reciprocal rank of the first accepted replacement in ``replacements`` against ``accepted``; 1 without cases."""
    ranks = F.array_min(F.filter(F.transform("accepted", lambda a: F.array_position("replacements", a)), lambda p: p > 0))
    return cases.agg(F.round(F.coalesce(F.avg(F.coalesce(1 / ranks, F.lit(0.0))), F.lit(1.0)), 6).alias("mrr"), F.count(F.lit(1)).alias("cases"))
