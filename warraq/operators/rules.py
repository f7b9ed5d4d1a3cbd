"""Literal rules, looked up at maximal runs of word characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions.resources import PREFIXES, RULES
from warraq.functions.scan import rows_of
from warraq.functions.text import WORD

SCHEMA = "surface string, words int, rule_id string, suggestion string, category string, severity string, confidence double, priority int, autofix boolean, profile string"


def surfaces() -> list[tuple]:
    """One row per surface a rule fires on: its pattern, and the pattern behind each prefix if it takes them."""
    out = []
    for rule, pattern, suggestion, *rest in RULES:
        *fields, prefixed, profile = rest
        for p in ("", *(PREFIXES if prefixed else ())):
            out.append((p + pattern, len(pattern.split()), rule, p + suggestion, *fields, profile))
    return out


def rule_table(spark: SparkSession, profiles: tuple[str, ...] | None = None) -> DataFrame:
    """The expanded rules, of active profiles only if given: filtered before any join."""
    rules = spark.createDataFrame(surfaces(), SCHEMA)
    return rules.where((F.col("profile") == "all") | F.col("profile").isin(*profiles)) if profiles is not None else rules


#: Surfaces of a rule pack, which every task holds.
MOST_SURFACES = 1_000_000
HIT = "start long, stop long, rule_id string, suggestion string, category string, severity string, confidence double, priority int, autofix boolean, profile string"
WORD_RUN = re.compile(f"[{WORD}]+")


class Literals:
    """Surfaces of one word or several, looked up at each run of word characters."""

    def __init__(self, rows: list[tuple]):
        self.rules: dict[str, list[tuple]] = {}
        for surface, _, *rule in rows:
            self.rules.setdefault(surface, []).append(tuple(rule))
        #: The most words of a surface that begins with a word.
        self.most: dict[str, int] = {}
        for surface in self.rules:
            first, n = surface.split(" ", 1)[0], surface.count(" ") + 1
            self.most[first] = max(n, self.most.get(first, 0))

    def hits(self, text: str) -> Iterator[tuple]:
        """Start, stop and the columns of each rule; words of a surface have exactly one blank between them."""
        runs = [(m.start(), m.end()) for m in WORD_RUN.finditer(text)]
        for i, (start, stop) in enumerate(runs):
            most = self.most.get(text[start:stop], 0)
            for k in range(i, min(i + most, len(runs))):
                if k > i and (runs[k][0] != stop + 1 or text[stop] != " "):
                    break
                stop = runs[k][1]
                for rule in self.rules.get(text[start:stop], ()):
                    yield start, stop, *rule


def literals(rules: DataFrame) -> Literals:
    """The rules as a look-up that is sent to every task; a pack of more than a million surfaces is an error."""
    rows = rules.select(*(x.split()[0] for x in SCHEMA.split(", "))).limit(MOST_SURFACES + 1).collect()
    if len(rows) > MOST_SURFACES:
        raise ValueError(f"more than {MOST_SURFACES} surfaces in a rule pack")
    return Literals([tuple(r) for r in rows])


def literal_hits(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of literals of any number of words: ``doc_id, start, stop`` and the rule's columns, in one pass over each text."""
    look_up = literals(rules)
    return rows_of(docs, look_up.hits, HIT)


#: Confidence and priority of a rule that gives none, by category; other categories have 0.8 and 0.
DEFAULTS = {"spelling": (0.99, 80), "punctuation": (0.98, 70), "grammar": (0.9, 60), "style": (0.72, 20), "dialect": (0.72, 30)}
RULE_ROW = "id string, category string, severity string, pattern string, suggestion string, confidence double, priority int, autofix boolean, profile string"


def canonical(rows: DataFrame) -> DataFrame:
    """Rules with defaults for what they leave out; one without an id, category or pattern is an error."""
    by = lambda k, other: F.coalesce(F.create_map(*[F.lit(x) for c, v in DEFAULTS.items() for x in (c, v[k])])[F.col("category")], F.lit(other))
    severity = F.coalesce("severity", F.lit("error"))
    sound = F.when(F.col("id").rlike(r"\A[A-Z0-9_:\-]+\z") & F.col("category").isNotNull() & (F.col("pattern") != ""), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("rule is not sound: "), F.coalesce("id", F.lit("no id")))))
    return rows.select(
        sound.alias("id"), "category", severity.alias("severity"), "pattern", "suggestion", F.coalesce("confidence", by(0, 0.8)).alias("confidence"),
        F.coalesce("priority", by(1, 0)).alias("priority"), F.coalesce("autofix", (F.col("category") == "spelling") & (severity == "error")).alias("autofix"), F.coalesce("profile", F.lit("all")).alias("profile"),
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rules from JSON lines; a malformed line or an id that occurs twice is an error."""
    rows = canonical(spark.read.schema(RULE_ROW).option("mode", "FAILFAST").json(path))
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return rows.withColumn("n", n).withColumn("id", F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("id occurs twice: "), F.col("id"))))).drop("n")
