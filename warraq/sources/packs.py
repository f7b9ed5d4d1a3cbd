"""Rule packs and resources from files: YAML rules, and typed JSON lists of dialect forms, tones, variants and lexemes."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.operators.rules import RULE_ROW, SCHEMA, canonical

#: What a resource's rows hold; numbers must lie in the range given.
RESOURCES = {
    "dialects": ("form string, dialect string, weight double", {"weight": (0.0, 3.0)}),
    "tones": ("tone string, form string, weight double", {"weight": (0.0, 3.0)}),
    "variants": ("grp string, form string", {}),
    "lexicon": ("lemma string, root string, template string, pos string, gender string, frequency long", {"frequency": (1, 10**12)}),
    "styles": ("id string, kind string, pattern string, replacement string, profile string, confidence double", {"confidence": (0.0, 1.0)}),
}


def _files(spark: SparkSession, folder: str, ending: str) -> list[tuple[str, str]]:
    """Names and contents of a folder's files, by name. A pack is small, and read on the driver."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{ending}").select(F.input_file_name().alias("name"), "value").collect()
    return sorted((r["name"], r["value"]) for r in rows)


def _sound(name: str, rows: object) -> list[dict]:
    if not isinstance(rows, list) or any(not isinstance(r, dict) for r in rows):
        raise ValueError(f"{name} is not a list of records")
    return rows


def _once(names: Iterable[str], what: str) -> None:
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise ValueError(f"{what} occurs twice: {n}")
        seen.add(n)


def read_rule_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical rules of all ``*.yaml`` files of a folder in the order of their names; each file is a list of rules.

    An id that occurs twice, a file that is no list of records and an unknown field are errors.
    """
    import yaml

    columns = [c.split()[0] for c in RULE_ROW.split(", ")]
    found = []
    for name, text in _files(spark, folder, ".yaml"):
        for rule in _sound(name, yaml.safe_load(text) or []):
            if unknown := set(rule) - {*columns, "prefixes"}:
                raise ValueError(f"{name}: unknown fields {sorted(unknown)}")
            given = dict.fromkeys(columns) | {k: v for k, v in rule.items() if k != "prefixes"}
            if given["confidence"] is not None:
                given["confidence"] = float(given["confidence"])
            prefixes = rule.get("prefixes") or []
            for p in ("", *prefixes):
                found.append((given["id"], p, tuple((p + given[c]) if p and c in ("pattern", "suggestion") and given[c] else given[c] for c in columns)))
    _once((i for i, p, _ in found if not p), "rule")
    return canonical(spark.createDataFrame([row for _, _, row in found], RULE_ROW))


def surfaces_of(rules: DataFrame) -> DataFrame:
    """Canonical literal rules as the surfaces that literal_hits() takes."""
    words = F.size(F.split("pattern", " "))
    rows = rules.select(F.col("pattern").alias("surface"), words.alias("words"), F.col("id").alias("rule_id"), "suggestion", "category", "severity", "confidence", "priority", "autofix", "profile")
    return rows.select(*(x.split()[0] for x in SCHEMA.split(", ")))


def read_resource(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Rows of a resource from a JSON list: typed, without unknown or missing fields, numbers in range, and no row twice."""
    schema, ranges = RESOURCES[kind]
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = []
    for name, text in _files(spark, path, ".json"):
        for r in _sound(name, json.loads(text)):
            if set(r) != set(columns):
                raise ValueError(f"{name}: a row has the fields {sorted(r)}")
            for c, (low, high) in ranges.items():
                if not low <= r[c] <= high:
                    raise ValueError(f"{name}: {c} is {r[c]}, not in {low} to {high}")
            rows.append(tuple(float(r[c]) if "double" in k else r[c] for c, k in zip(columns, schema.split(", "), strict=True)))
    _once(map(str, rows), "row")
    return spark.createDataFrame(rows, schema)
