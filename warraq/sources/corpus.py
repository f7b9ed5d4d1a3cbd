"""Readers: driver tables, the synthetic Arabic corpus, typed JSON lines, whole text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions.resources import GRAMMAR_SENTENCES, SENTENCES

CASE = (
    "schema_version int, id string, text string, domain string, split string, dialect string, "
    "annotations array<struct<category: string, offset: int, length: int, accepted_replacements: array<string>, label: string, severity: string>>, metadata map<string, string>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt to all cores where the table has fewer splits than there are; a large table is read as it lies."""
    rows, n = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return rows if rows._jdf.rdd().getNumPartitions() >= n else rows.repartition(n)


def arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arabic_of(documents(spark, sf_dir))


def arabic_of(docs: DataFrame) -> DataFrame:
    """Three sentences per document, chosen by arithmetic on doc_id, and behind them the document's own whole text."""
    n, all_ = len(SENTENCES), F.array(*map(F.lit, SENTENCES))
    pick = lambda e: F.element_at(all_, (e % n + 1).cast("int"))
    d = F.col("doc_id")
    return docs.select("doc_id", "lang", "source", F.concat_ws(" ", pick(d), pick(F.floor(d / n) * 7 + d + 1), pick(d * 13 + 2), "text").alias("text"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases from JSON lines. A malformed line, or an id that occurs twice, is an error."""
    cases = spark.read.schema(CASE).option("mode", "FAILFAST").json(path)
    twice = cases.groupBy("id").count().where("count > 1").limit(1)
    checked = twice.agg(F.first("id").alias("twice"))
    ok = F.when(F.col("twice").isNotNull(), F.raise_error(F.concat(F.lit("id occurs twice: "), F.col("twice")))).otherwise(True)
    return cases.crossJoin(F.broadcast(checked)).where(ok).drop("twice")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``path, text`` without a byte order mark."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return rows.select("path", F.regexp_replace("value", "^﻿", "").alias("text"))


def grammar_of(docs: DataFrame) -> DataFrame:
    """Three sentences for grammar and style per document, chosen by arithmetic on doc_id."""
    n, all_ = len(GRAMMAR_SENTENCES), F.array(*map(F.lit, GRAMMAR_SENTENCES))
    pick = lambda e: F.element_at(all_, (e % n + 1).cast("int"))
    d = F.col("doc_id")
    return docs.select("doc_id", "lang", "source", F.concat_ws(" ", pick(d), pick(d * 5 + 1), pick(d * 11 + 3)).alias("text"))


def grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar_of(documents(spark, sf_dir))
