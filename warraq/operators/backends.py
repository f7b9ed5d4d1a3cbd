"""Rankers of candidates that can be exchanged: anything with a name that scores batches of features."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from warraq.functions.workers import importable


class Backend(Protocol):
    """Scores of a batch of candidates by their features; a backend is sent to every task, and may load its model at its first batch."""

    name: str

    def available(self) -> bool: ...

    def score(self, batch: Sequence[Mapping[str, float]]) -> Sequence[float]: ...


@dataclass(frozen=True)
class Weighted:
    """A bias and weights by feature."""

    weights: Mapping[str, float]
    bias: float = 0.0
    name: str = "weighted"

    def available(self) -> bool:
        return True

    def score(self, batch: Sequence[Mapping[str, float]]) -> Sequence[float]:
        return [self.bias + sum(self.weights.get(f, 0.0) * x for f, x in row.items()) for row in batch]


def first_available(backends: Sequence[Backend]) -> Backend:
    """The first backend that is there; none is an error."""
    for b in backends:
        if b.available():
            return b
    raise ValueError(f"none of {[b.name for b in backends]} is available")


def scored(candidates: DataFrame, backend: Backend, features: str = "features") -> DataFrame:
    """candidates with ``score``, by batches of a map column of features; a null map is an empty one."""
    importable(candidates.sparkSession)
    schema = StructType([*candidates.schema.fields, StructField("score", DoubleType())])
    at = candidates.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = backend.score([dict(x or ()) for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=schema.names)

    return candidates.mapInArrow(run, schema)


def decided(rows: DataFrame, key: str, candidate: str, temperature: float = 0.82, least: float = 0.985, margin: float = 0.70) -> DataFrame:
    """The best candidate of each key by softmax over scores, its probability and its lead; accepted if both are large enough. Ties by name."""
    per = Window.partitionBy(key)
    e = F.exp((F.col("score") - F.max("score").over(per)) / temperature)
    rows = rows.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(per))
    order = per.orderBy(F.desc("score"), candidate)
    top = rows.withColumns({"nth": F.row_number().over(order), "lead": F.col("prob") - F.coalesce(F.lead("prob").over(order), F.lit(0.0))}).where("nth = 1")
    return top.select(key, candidate, F.round("prob", 6).alias("prob"), F.round("lead", 6).alias("margin"), ((F.col("prob") >= least) & (F.col("lead") >= margin)).alias("accepted"))
