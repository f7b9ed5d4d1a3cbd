"""Mixing of sources to target weights by Pfair scheduling.

A source's documents, in an order by hash, are cut into blocks. In the fluid mix all sources run at
once at rates in the proportion of their weights, and when one is used up the others share its rate.
The fluid mix gives each block the time at which it begins and ends; the slot before is its release
and the slot after its deadline. In each slot the block with the earliest deadline of those released
runs. No deadline is missed, so at any slot each source is less than one block off the fluid mix, and
off its target weight until a source is used up. Weights are exact, as whole parts of their sum.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cmp_to_key
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.llm.common import scratch_path, ship

BLOCK_DOCS = 64
#: Documents of a source that are ranked together.
BUCKET = 4096
#: Slots that the driver holds before it writes them.
STRETCH = 500_000


def whole_parts(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    ratios = [w.as_integer_ratio() for w in weights]
    common = math.lcm(*(d for _, d in ratios))
    parts = [n * (common // d) for n, d in ratios]
    divisor = math.gcd(*parts)
    return [p // divisor for p in parts]


class Fluid:
    """The fluid mix of sources with so many ``blocks`` and ``parts`` of the weight."""

    def __init__(self, blocks: list[int], parts: list[int]):
        self.parts = parts
        # Sources that end at the same time are one event: its ratio, and the blocks and parts that end there.
        self.ended: list[tuple[int, int]] = []
        sums: list[list[int]] = []
        for n, p in sorted(zip(blocks, parts, strict=True), key=cmp_to_key(lambda x, y: x[0] * y[1] - y[0] * x[1])):
            if not self.ended or self.ended[-1][0] * p != n * self.ended[-1][1]:
                self.ended.append((n, p))
                sums.append([0, 0])
            sums[-1][0] += n
            sums[-1][1] += p
        self.at = [n / p for n, p in self.ended]
        self.used = [*accumulate((n for n, _ in sums), initial=0)]
        self.rest = [*accumulate((p for _, p in reversed(sums)), initial=0)][::-1]

    def time(self, source: int, done: int) -> tuple[int, int]:
        """Numerator and denominator of the time at which so many blocks of the source are done: ``used`` blocks of
        the sources that ended before, and of each other one as many as its part allows."""
        p, ended = self.parts[source], self.ended
        k = bisect_left(self.at, done / p)
        # The quotients are rounded; whole numbers decide.
        while k < len(ended) and ended[k][0] * p <= done * ended[k][1]:
            k += 1
        while k and ended[k - 1][0] * p > done * ended[k - 1][1]:
            k -= 1
        return self.used[k] * p + done * self.rest[k], p

    def window(self, source: int, block: int) -> tuple[int, int]:
        """Release and deadline of a block."""
        a, p = self.time(source, block)
        b, _ = self.time(source, block + 1)
        return a // p, -(-b // p)


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int, int, int]]:
    """``(source, block, slot, release, deadline)`` by slot: earliest deadline first among released blocks."""
    fluid = Fluid(blocks, whole_parts(weights))
    waiting = [(*fluid.window(s, 0), s, 0) for s, n in enumerate(blocks) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            release, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i, release))
        deadline, s, i, release = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        yield s, i, t, release, deadline
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (*fluid.window(s, i + 1), s, i + 1))


def scheduled(spark: SparkSession, blocks: list[int], weights: list[float]) -> DataFrame:
    """The schedule as a table in the shared folder; the driver holds a stretch of slots at a time."""
    names, path, slots = ("slot_source", "block", "slot", "release", "deadline"), scratch_path(spark, "schedule"), schedule(blocks, weights)
    schema = pa.schema([(n, pa.int64()) for n in names])
    while True:
        some = list(islice(slots, STRETCH))
        part = pa.table([pa.array(c, pa.int64()) for c in zip(*some, strict=True)] or [pa.array([], pa.int64())] * len(names), schema=schema)
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)
        if len(some) < STRETCH:
            return spark.read.parquet(path)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, seed: int = 11, id_col: str = "doc_id", source_col: str = "source", text_col: str | None = "text") -> DataFrame:
    """docs with ``block, release, deadline, slot, position``: the order of all documents mixed to the weights.

    ``weights`` None: the square root of each source's number of documents. A source that weights
    leave out gets the least weight given; null is a source of its own. No row is dropped or
    repeated. Counts by source, a row each, are the only thing that reaches the driver, which schedules
    block by block and writes the slots to the shared folder; ``block_docs`` sets how many there are. Within a source
    documents are ordered by a hash of doc_id, then id and text; rows that are equal in all of these
    are interchangeable, and null ids count as equal. Hot sources are ranked in buckets by that hash. Columns of docs by the
    names of the new ones are replaced, whatever others are called. An empty table gives no rows.
    """
    spark = ship(docs.sparkSession)
    fresh = ("block", "release", "deadline", "slot", "position")
    docs = docs.drop(*fresh)
    ties = [id_col] + ([text_col] if text_col else [])
    # The row goes along as one column, so that its names meet none of ours.
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("name"), F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)).alias("hash"))
    counted = [(r["name"], r["n"]) for r in docs.groupBy(F.col(source_col).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()]
    counted.sort(key=lambda x: (x[0] is not None, x[0]))
    least = min(weights.values()) if weights else 1.0
    shares = [n**0.5 if weights is None else weights.get(s, least) for s, n in counted]
    if any(w <= 0 for w in shares):
        raise ValueError("weights must be positive")
    slots = scheduled(spark, [-(-n // block_docs) for _, n in counted], shares)
    known = spark.createDataFrame([(i, s, -(-n // BUCKET)) for i, (s, n) in enumerate(counted)], "source long, known string, buckets long")
    rows = rows.join(known, F.col("name").eqNullSafe(F.col("known"))).drop("name", "known")
    # The hash as a fraction of its range, times the number of buckets.
    rows = rows.withColumn("bucket", F.least(F.floor((F.col("hash") / F.lit(2.0**64) + F.lit(0.5)) * F.col("buckets")), F.col("buckets") - 1))
    sizes = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("hash", *(F.col(f"row.`{c}`") for c in ties))
    ranked = rows.withColumn("nth", F.row_number().over(in_bucket)).join(before, ["source", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    ranked = ranked.select("row", "source", "rank", F.floor(F.col("rank") / block_docs).alias("nth_block"))
    out = ranked.join(slots, (F.col("source") == F.col("slot_source")) & (F.col("nth_block") == F.col("block")))
    position = F.col("slot") * block_docs + F.pmod(F.col("rank"), F.lit(block_docs))
    return out.select("row.*", "block", "release", "deadline", "slot", position.alias("position"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Mixed rows in ranges of their positions, each in order."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "position").sortWithinPartitions("position")
