"""Spans: overlap filters and conflict resolution."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from warraq.functions.workers import importable

BIN = 256


def drop_overlapping(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """Candidates that overlap no accepted span of their document. Spans are half-open; touching is no overlap.

    Both sides are dealt to bins of 256 code points, so the join is on (doc_id, bin) and a long
    document's spans meet only their neighbours.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.greatest("stop", F.col("start") + 1) - 1) / BIN))).alias("bin")
    keyed = candidates.withColumn("span_id", F.struct("doc_id", "start", "stop"))
    left = keyed.select("span_id", "doc_id", "start", "stop", bins()).distinct()
    right = accepted.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("stop").alias("e"), bins()).withColumnRenamed("bin", "b")
    hit = left.join(right, (F.col("doc_id") == F.col("d")) & (F.col("bin") == F.col("b")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("stop"))).select("span_id").distinct()
    return keyed.join(hit, "span_id", "left_anti").drop("span_id")


def rank_key() -> Column:
    """Priority, confidence, severity, a replacement, length, then position and rule."""
    severity = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    return F.struct(-F.col("priority"), -F.col("confidence"), -severity, F.when(F.col("suggestion").isNull(), 1).otherwise(0), F.col("start") - F.col("stop"), "start", "rule_id")


def kept(spans: Iterable[tuple[int, int]]) -> Iterator[int]:
    """Numbers of the spans that overlap none kept before, in the order given. Kept spans are held sorted, so each takes a bisection."""
    starts: list[int] = []
    stops: list[int] = []
    for n, (start, stop) in enumerate(spans):
        k = bisect_left(starts, stop)
        # Of the kept spans that begin before this one ends, the last ends last, as they are disjoint.
        if k and stops[k - 1] > start:
            continue
        starts.insert(k, start)
        stops.insert(k, stop)
        yield n


def resolve(matches: DataFrame, key: Column | None = None) -> DataFrame:
    """Greedily keep, in order of the key, each match that overlaps none kept before: ``doc_id, start, stop, rule_id, suggestion``."""
    item = F.struct((rank_key() if key is None else key).alias("key"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "rule_id", "suggestion")
    rows = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    rows = rows.select("doc_id", F.transform("all", lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["rule_id"].alias("rule_id"), m["suggestion"].alias("suggestion"))).alias("all"))
    importable(matches.sparkSession)
    schema = StructType([matches.schema["doc_id"], *_parse_datatype_string("start long, stop long, rule_id string, suggestion string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(1)
            flat, sizes = every.flatten(), every.value_lengths().to_pylist()
            start, stop = flat.field("start").to_pylist(), flat.field("stop").to_pylist()
            of, rows, at = [], [], 0
            for i, n in enumerate(sizes):
                here = [at + k for k in kept(zip(start[at : at + n], stop[at : at + n], strict=True))]
                of += [i] * len(here)
                rows += here
                at += n
            chosen = flat.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(chosen.field(k) for k in range(4))], names=schema.names)

    return rows.mapInArrow(run, schema)
