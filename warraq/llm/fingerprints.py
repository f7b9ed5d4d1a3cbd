"""Context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever its low bits are all set, so boundaries follow
the content. Each chunk, with the six bytes before it, gives one symbol of twelve bits (two base64
characters). A fingerprint is ``block size:signature:signature at twice that size``; two are compared
by the edit distance (insertions and deletions) of signatures at a block size that both have.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.common import ship, stored, whole

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SYMBOLS = [a + b for a in ALPHABET for b in ALPHABET]
CHUNKS, SPAN = 64, 7
#: Odd multipliers of the rolling window, the powers of one prime.
POWERS = [pow(0x01000193, k + 1, 1 << 32) for k in range(SPAN)]


def block_size(n: int) -> int:
    """The least power of two of which 64 cover n bytes."""
    return 1 << max(0, (n - 1).bit_length() - 6) if n else 1


def rolling(data: bytes) -> np.ndarray:
    """At each byte, a mixed hash of it and the six before it."""
    x = np.frombuffer(b"\0" * (SPAN - 1) + data, np.uint8).astype(np.uint32)
    n = len(data)
    h = np.zeros(n, np.uint32)
    for k, p in enumerate(POWERS):
        h += x[SPAN - 1 - k : SPAN - 1 - k + n] * np.uint32(p)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(8)


def signature(data: bytes, ends: np.ndarray, size: int) -> str:
    """One symbol per chunk; a boundary within a quarter of the block size of the last is passed over, which bounds the length."""
    out, start, least = [], 0, max(1, size // 4)
    for end in ends.tolist():
        if end + 1 - start >= least:
            out.append(SYMBOLS[zlib.crc32(data[max(0, start - SPAN + 1) : end + 1]) & 0xFFF])
            start = end + 1
    if start < len(data):
        out.append(SYMBOLS[zlib.crc32(data[max(0, start - SPAN + 1) :]) & 0xFFF])
    return "".join(out)


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    size = block_size(len(data))
    h = rolling(data)
    ends = np.flatnonzero((h & np.uint32(size - 1)) == size - 1)
    twice = ends[(h[ends] & np.uint32(2 * size - 1)) == 2 * size - 1]
    return f"{size}:{signature(data, ends, size)}:{signature(data, twice, 2 * size)}"


def _alike(a: str, b: str) -> float:
    """1 less the edit distance over the number of symbols, by bit-parallel longest common subsequence."""
    n, m = len(a) // 2, len(b) // 2
    if a == b:
        return 1.0
    if not n or not m:
        return 0.0
    where: dict[str, int] = {}
    for i in range(n):
        s = a[2 * i : 2 * i + 2]
        where[s] = where.get(s, 0) | 1 << i
    full = (1 << n) - 1
    v = full
    for j in range(m):
        if u := v & where.get(b[2 * j : 2 * j + 2], 0):
            v = (v + u | v - u) & full
    return 2 * (n - v.bit_count()) / (n + m)


def likeness(a: str, b: str) -> float:
    """0 to 1. Equal fingerprints give 1, block sizes that are not equal or double give 0."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    p, q = int(x), int(y)
    if p == q:
        return max(_alike(a1, b1), _alike(a2, b2) if a2 and b2 and len(a2) > 6 else 0.0)
    if p == 2 * q:
        return _alike(a1, b2)
    return _alike(a2, b1) if q == 2 * p else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of every whole text; null counts as empty, whose fingerprint is ``1::``."""
    from pyspark.sql.functions import pandas_udf

    ship(df.sparkSession)

    @pandas_udf("string")
    def of(texts):
        return texts.map(fingerprint)

    return df.withColumn(out_col, of(whole(text_col)))


def _row(doc: int | None, text: str, mine: str, following: str, theirs: str) -> tuple:
    made = edited(text, following)
    its = fingerprint(made)
    return doc, len(text), hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest(), mine, its, likeness(mine, its), likeness(mine, theirs)


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its half-edited text, and hold it against the next document's.

    Order is ascending doc_id (nulls first, ties by text), the last is followed by the first. Texts
    are shuffled once, by ranges of doc_id; each range is read in order with two texts in memory, and
    its first and last text are joined to the neighbouring ranges' afterwards. A null text is empty.
    A single document follows itself; an empty table gives no rows; other columns are not read.
    """
    spark = ship(docs.sparkSession)
    schema = SCHEMA + ", part int, side string, text string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, out = TaskContext.get().partitionId(), None, []

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = fingerprint(text)
                if last is None:
                    out.append((doc, None, None, mine, None, None, None, part, "first", text))
                else:
                    out.append((*_row(*last, text, mine), part, "inner", None))
                last = doc, text, mine
            if out:
                yield batch()
                out = []
        if last:
            out.append((last[0], None, None, last[2], None, None, None, part, "last", last[1]))
            yield batch()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(*r) for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
            if rows:
                types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names[:7])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    made = stored(ordered.mapInArrow(run, schema), "fingerprints")
    # One number per range that has rows, as many as shuffle partitions at most.
    parts = [r["part"] for r in made.where("side = 'first'").select("part").orderBy("part").collect()]
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    ends = made.where("side = 'last'").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(follows), "part")
    heads = made.where("side = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("theirs"))
    tail = ends.join(heads, "next").select("doc_id", "text", "fingerprint", "following", "theirs").mapInArrow(close, SCHEMA)
    return made.where("side = 'inner'").select(*names[:7]).unionByName(tail)
