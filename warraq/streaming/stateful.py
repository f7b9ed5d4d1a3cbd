"""Operators on streams. ``token_bucket`` and ``consistency_tracker`` keep state by key and need a stream; the others take batches too."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from warraq.functions.resources import VARIANTS
from warraq.functions.text import LETTERS, MARKS, STROKE, WORD
from warraq.functions.workers import importable
from warraq.operators import analytics


def stream_of(batch: DataFrame, path: str) -> DataFrame:
    """The files of a path, of the schema of ``batch``, as a stream."""
    return batch.sparkSession.readStream.schema(batch.schema).parquet(path)


def shared(spark: SparkSession) -> str:
    """A new name in the folder that all executors see; where none is set, a folder of our own on a local master, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="warraq-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def played(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there, to a Parquet sink in the shared folder, and read what it wrote."""
    spark = stream.sparkSession
    to = shared(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{to}/state").option("path", f"{to}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{to}/out")


def _tracker(groups: dict[str, str]):
    import re

    word = re.compile(f"[{LETTERS}](?:[{WORD}]*[{LETTERS}{MARKS}])?")
    drop = re.compile(f"[{MARKS}{STROKE}]")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, preferred, chars = state.get if state.exists else ([], [], 0)
        first = dict(zip(names, preferred, strict=True))
        rows = pd.concat(list(parts)).sort_values("turn", kind="stable")
        out = []
        for turn, text in zip(rows["turn"], rows["text"], strict=True):
            text = text or ""
            for m in word.finditer(text):
                group = groups.get(drop.sub("", m[0]))
                if group and first.setdefault(group, m[0]) != m[0]:
                    out.append((key[0], turn, group, chars + m.start(), chars + m.end(), m[0], first[group]))
            chars += len(text)
        state.update((list(first), list(first.values()), chars))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "grp", "start", "stop", "piece", "preferred"])

    return run


def consistency_tracker(chunks: DataFrame) -> DataFrame:
    """Variants that differ from the first seen of their group, over the chunks ``conv_id, turn, text`` of a growing document.

    The first surface of each group and the number of code points so far are the state of a document,
    so offsets go on across chunks and micro-batches. Chunks of a micro-batch are taken by turn.
    """
    importable(chunks.sparkSession)
    return chunks.groupBy("conv_id").applyInPandasWithState(
        _tracker({form: group for group, form in VARIANTS}), "conv_id long, turn long, grp string, start long, stop long, piece string, preferred string",
        "names array<string>, preferred array<string>, chars long", "append", GroupStateTimeout.NoTimeout,
    )


def token_bucket(events: DataFrame, capacity: float = 5.0, per_second: float = 0.001, late: str = "7 days") -> DataFrame:
    """Whether each event ``user_id, event_id, ms`` is let through by a bucket that refills over event time.

    State is the user's level and last time; an event that is late by its time refills nothing. A user of whom nothing came for four
    times as long as a bucket takes to fill, five minutes at least, is forgotten once the watermark, ``late`` behind, has passed, so state
    does not grow with users for ever; a forgotten bucket was full.
    """
    idle = max(300_000, int(4 * capacity / per_second * 1000))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(parts)).sort_values(["ms", "event_id"])
        allowed = []
        for ms in rows["ms"]:
            if last is not None:
                level = min(capacity, level + max(0, ms - last) / 1000 * per_second)
            last = ms if last is None else max(last, ms)
            allowed.append(level >= 1)
            level -= level >= 1
        state.update((float(level), int(last)))
        state.setTimeoutTimestamp(max(int(last) + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    importable(events.sparkSession)
    timed = events.select("user_id", "event_id", "ms", F.timestamp_millis("ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, allowed boolean", "level double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def undelivered(records: DataFrame, delivered: DataFrame, node: str) -> DataFrame:
    """Records newer than each peer's delivered cursor and not of its own node, once each: ``peer, doc, ms, seq``."""
    seen = delivered.select("peer", "doc", F.struct("ms", "seq").alias("seen"))
    fresh = records.where(F.col("origin") != node).dropDuplicates(["doc", "ms", "seq"])
    return fresh.join(seen, "doc").where(F.col("seen.ms").isNull() | (F.struct("ms", "seq") > F.col("seen"))).select("peer", "doc", "ms", "seq")


def windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and tumbling window of event time; on a stream, late rows are dropped behind the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("since"), "event_type", "n")


def learn_voices(samples: DataFrame, to: str, key: str) -> DataFrame:
    """Profiles by ``key`` from a stream of ``doc_id, key, text``, played to its end; ``to`` is a shared folder.

    A micro-batch writes its sums under its number, so a batch that is run again replaces its own; sums are
    merged when they are read. Samples without words count for nothing.
    """

    def batch(rows: DataFrame, n: int) -> None:
        analytics.moments(analytics.features(analytics.fingerprint(rows, key), key), key).write.mode("overwrite").parquet(f"{to}/sums/batch={n}")

    samples.writeStream.foreachBatch(batch).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start().awaitTermination()
    kind = f"`{key}` string, feature string, n bigint, s decimal(38,0), q decimal(38,0)"
    return analytics.profile(analytics.merged(samples.sparkSession.read.schema(kind).parquet(f"{to}/sums/*"), key))


def journal(records: DataFrame, after: DataFrame) -> DataFrame:
    """A stream of journal records ``doc, ms, seq, ..`` from each document's cursor in ``after(doc, ms, seq)`` on; without one, from the beginning.

    Cursors compare as pairs of numbers. Progress is kept in the stream's checkpoint, so a reader that is started again goes on where it was.
    """
    seen = after.select("doc", F.struct("ms", "seq").alias("seen"))
    return records.join(seen, "doc", "left").where(F.col("seen").isNull() | (F.struct("ms", "seq") > F.col("seen"))).drop("seen")
