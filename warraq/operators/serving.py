"""Contract rows and small record operators: positions, context windows, digits, manifests, compaction, pooling, softmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WESTERN, ARABIC_INDIC = "0123456789", "٠١٢٣٤٥٦٧٨٩"


def positions(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Line from zero and column in UTF-16 units of each span's start."""
    rows = spans.join(docs.select("doc_id", "text"), "doc_id")
    before = F.substring("text", F.lit(1), F.col("start").cast("int"))
    line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))
    tail = F.element_at(F.split(before, "\n"), -1)
    wide = F.char_length(tail) - F.char_length(F.regexp_replace(tail, r"[\x{10000}-\x{10FFFF}]", ""))
    return rows.select(*spans.columns, line.cast("long").alias("line"), (F.char_length(tail) + wide).cast("long").alias("col"))


def context(spans: DataFrame, docs: DataFrame, width: int = 20) -> DataFrame:
    """The text around each span and where in it the span begins."""
    left = F.greatest(F.col("start") - width, F.lit(0)).cast("int")
    rows = spans.join(docs.select("doc_id", "text"), "doc_id")
    return rows.select(*spans.columns, F.substring("text", left + 1, (F.col("stop") + width - left).cast("int")).alias("context"), (F.col("start") - left).cast("long").alias("context_offset"))


def to_western(text: Column) -> Column:
    return F.translate(text, ARABIC_INDIC, WESTERN)


def oblique(word: Column) -> Column:
    """Sound masculine plural or dual of the nominative in its oblique form; other words as they are."""
    cut = F.substring(word, F.lit(1), F.char_length(word) - 2)
    return F.when(word.endswith("ون") | word.endswith("ان"), F.concat(cut, F.lit("ين"))).otherwise(word)


def manifest(docs: DataFrame, *keys: str) -> DataFrame:
    """Documents, characters and distinct texts, for all and by each key."""
    rows = docs.withColumn("h", F.md5("text"))
    return rows.groupingSets([[], *([F.col(k)] for k in keys)], *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.char_length("text")).cast("long").alias("chars"), F.count_distinct("h").alias("texts")).select(*[F.coalesce(k, F.lit("*")).alias(k) for k in keys], "docs", "chars", "texts")


def compacted(updates: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Updates that no acknowledged cursor of their document covers."""
    last = acknowledged.groupBy("doc").agg(F.max("seq").alias("upto"))
    return updates.join(last, (updates["doc"] == last["doc"]) & (updates["seq"] <= F.col("upto")), "left_anti")


def latest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key, newest first."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))).cast("long")).where(F.col("nth") <= n)


def softmax(rows: DataFrame, key: str, value: str, temperature: float = 0.82) -> DataFrame:
    """Probabilities of the values of a key, taken from its maximum so that nothing overflows."""
    by = Window.partitionBy(key)
    e = F.exp((F.col(value) - F.max(value).over(by)) / temperature)
    return rows.withColumn("e", e).withColumn("prob", F.round(F.col("e") / F.sum("e").over(by), 5)).drop("e")


def sized(docs: DataFrame, most: int = 50_000) -> DataFrame:
    """Each document with its length and whether it is short enough to be served; a null text counts as empty."""
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", n.alias("n"), (n <= most).alias("accepted"))
