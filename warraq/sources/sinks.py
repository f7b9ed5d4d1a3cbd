"""Sinks: reports as JSON, training rows as JSON lines, draft rules as YAML, texts as files, and stores by key.

A write is committed as a whole: Spark moves files into place when all tasks have ended, and a failed one leaves what was there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rules of a draft, which are written by the driver.
MOST_RULES = 10_000


def write_report(rows: DataFrame, path: str) -> None:
    """A row of JSON per row, with fields that are null left in."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """One YAML list of rules by id, as read_rule_pack() reads it; more than 10,000 are an error."""
    import yaml

    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in rules.orderBy("id").limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules in a draft")
    text = yaml.safe_dump(rows, allow_unicode=True, sort_keys=False) if rows else "[]\n"
    spark = rules.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = spark._jvm.org.apache.hadoop.fs.Path(path + ".draft")
    out = files.create(draft, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    files.delete(hadoop, False)
    files.rename(draft, hadoop)


def markdown(title: str, text: str):
    """A column of a Markdown document with a title."""
    return F.concat(F.lit("# "), F.regexp_replace(F.col(title), r"\s+", " "), F.lit("\n\n"), F.col(text), F.lit("\n"))


def write_texts(rows: DataFrame, path: str, key: str, text: str = "text") -> None:
    """Each text in a folder of its key, ``key=value``; texts with line ends stay whole."""
    rows.select(F.col(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\x00").text(path)


def put(store: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """A store with changes put in: of each key the row that is last by order; one whose ``deleted`` is true goes."""
    rows = store.unionByName(changes, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("nth", last).where("nth = 1 and not coalesce(deleted, false)").drop("nth")


def due(outbox: DataFrame, now: int, most: int) -> DataFrame:
    """The first entries of an outbox ``id, due_ms, created_ms`` that are due: by due time, then by creation."""
    return outbox.where(F.col("due_ms") <= now).orderBy("due_ms", "created_ms", "id").limit(most)
