"""Shared plumbing: scratch tables in the shared folder, worker imports, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_OWN_DIR: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder of our own on a local master, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="warraq-scratch-"))
        base = _OWN_DIR[0]
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that survives lost executors.

    The shuffle files of the write are of no use afterwards and go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # A frame of its own takes the setting that holds now.
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._warraq_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by stored() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_warraq_path", None):
            remove(df.sparkSession, path)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted batches that agree in the first ``n_keys`` columns of whole numbers, as one batch a time."""
    held: list[pa.RecordBatch] = []
    at: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(int(k[lo]) for k in keys)
            if held and key != at:
                yield pa.concat_batches(held)
                held = []
            at = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``.

    Alternating large-star and small-star contraction. Each round joins every edge with the least
    neighbour of one end, so a node of any degree is pre-aggregated to one row and never gathered.
    Returns ``(node, component)`` for every node that is not itself the least of its component.
    Self loops and repeated edges are ignored; no edges give no rows.
    """
    flat = edges.where("a <> b and a is not null and b is not null")
    cur = stored(flat.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = _mark(cur)
    while mark[0]:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        new = stored(small, name)
        discard(cur)
        cur, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out._warraq_path = cur._warraq_path
    return out


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0
