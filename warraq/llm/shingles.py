"""Weighted word shingles, shared by near-dedup and its checks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.common import groups, ship

WIDTH = 5
#: Document frequencies up to this number are kept as they are, larger ones to a fifth of a doubling, so that each is one byte.
EXACT = 128
STEPS = 5
#: Scripts that are written without blanks (Thai, Lao, Myanmar, Khmer, Han and Kana), each character of which is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD, WORD_OR_SIGN, SIGN = re.compile(r"\w+"), re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]"), re.compile(f"[{UNSPACED}]")
#: Characters of the first three planes; those beyond are signs, a word each.
PLANES = 0x30000
#: An odd base of words' hashes, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Odd multipliers of the five words of a shingle.
MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xC2B2AE3D27D4EB4F << k)) % (1 << 64) | 1 for k in range(WIDTH)]


def words_of(text: str) -> list[str]:
    """Words of a text in lower case; the plain pattern, which is faster, serves texts of scripts with blanks."""
    text = text.lower()
    return (WORD if text.isascii() or not SIGN.search(text) else WORD_OR_SIGN).findall(text)


class WordHashes:
    """64-bit hashes of a text's words, all at once: sums of characters times powers of a base, from one running sum over the text."""

    def __init__(self):
        kinds = bytearray(PLANES + 1)
        for k in range(PLANES):
            c = chr(k)
            kinds[k] = c.isalnum() or c == "_"
        for m in SIGN.finditer("".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, PLANES)))):
            kinds[ord(m[0])] = 2
        kinds[PLANES] = 2
        self.kinds = np.frombuffer(bytes(kinds), np.uint8)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.full(n + 1, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.up, self.down = powers(BASE), powers(INVERSE)

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words in lower case: runs of letters, digits and underlines, and each character of a script without blanks.

        Of a text that has none, those of its parts between blanks.
        """
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if n >= len(self.up):
            self._grow(2 * n)
        kind = self.kinds.take(points, mode="clip")
        run, sign = kind == 1, kind == 2
        edge = np.empty(n + 1, bool)
        edge[:n] = run
        edge[n] = False
        first = run.copy()
        first[1:] &= ~run[:-1]
        last = run & ~edge[1:]
        starts, ends = np.flatnonzero(first | sign), np.flatnonzero(last | sign) + 1
        if not len(starts):
            return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(points * self.down[:n], out=sums[1:], dtype=np.uint64)
        return mixed(mixed((sums[ends] - sums[starts]) * self.up[starts]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingled(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, ascending, and how often each occurs.

    A text of fewer than five words is one shingle; a text without words has none.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = min(WIDTH, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h += words[k : n - width + 1 + k] * np.uint64(MULTIPLIERS[k])
    return np.unique(mixed(h), return_counts=True)


def codes_of(frequencies: np.ndarray) -> np.ndarray:
    """One byte for each document frequency."""
    large = EXACT + np.rint(STEPS * np.log2(np.maximum(frequencies, EXACT) / EXACT))
    return np.where(frequencies <= EXACT, frequencies - 1, np.minimum(large - 1, 255)).astype(np.uint8)


def inverse_frequencies(documents: int) -> np.ndarray:
    """ln((documents + 1) / (documents with the shingle + 1)) + 1 by code."""
    code = np.arange(256)
    frequency = np.where(code < EXACT, code + 1, EXACT * 2.0 ** ((code - EXACT + 1) / STEPS))
    return np.maximum(np.log((documents + 1) / (frequency + 1)), 0) + 1


def jaccards(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> list[float]:
    """Sum of the lesser over sum of the greater weights, for each kind of weights of ``(shingles, weights, ...)``."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    out = []
    for x, y in zip(a[1:], b[1:], strict=True):
        shared = float(np.minimum(x[i], y[j]).sum())
        total = float(x.sum() + y.sum()) - shared
        out.append(shared / total if total > 0 else 0.0)
    return out


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    return jaccards(a, b)[0]


class Block:
    """Several weighted sets held for comparison with one at a time."""

    def __init__(self, sets: list[tuple[np.ndarray, ...]]):
        ids = np.concatenate([x[0] for x in sets])
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.weights = [np.concatenate(kind)[order] for kind in zip(*(x[1:] for x in sets), strict=True)]
        self.owner = np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets])[order]
        self.totals = [np.array([w.sum() for w in kind]) for kind in zip(*(x[1:] for x in sets), strict=True)]

    def jaccards(self, one: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Weighted Jaccard similarity of one set to each of the block's, for each kind of weights."""
        low, high = np.searchsorted(self.ids, one[0], "left"), np.searchsorted(self.ids, one[0], "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        owner, out = self.owner[at], []
        for mine, weights, total in zip(one[1:], self.weights, self.totals, strict=True):
            shared = np.bincount(owner, np.minimum(weights[at], np.repeat(mine, n)), len(total))
            both = total + mine.sum() - shared
            out.append(np.divide(shared, both, out=np.zeros_like(both), where=both > 0))
        return out


#: Bits of a shingle's hash by which document frequencies are counted, and the size of a count's part that is worked on at a time.
KEY_BITS = 56
PART_SHINGLES = 1 << 21
#: Texts whose shingles are counted before they are handed on, as a power of two.
RUN_BITS = 10


def packed(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences, byte plane by byte plane, which leaves the leading zeros in a row."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def document_frequencies(texts: DataFrame, chars: int) -> DataFrame:
    """``run, part, keys, codes``: for each run of ``texts(pid, n, text)``, those of its shingles that more than one document
    holds, ascending within a part, and the codes of how many do.

    A run is 1,024 texts by pid, each held by ``n`` documents. Shingles are counted within a run before they are shuffled, by parts of the
    hash, of which there are more the more ``chars`` there are. A shingle that all documents hold is one entry of each run.
    """
    ship(texts.sparkSession)
    bits = max(0, math.ceil(math.log2(max(1, chars / 6 / PART_SHINGLES))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.repeat([n for _, n in held], [len(k) for k, _ in held]))
            ends = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS - bits)).tolist() + [len(keys)]
            rows = [(p, at, packed(keys[lo:hi]), b"" if (counts[lo:hi] == 1).all() else counts[lo:hi].astype("<i8").tobytes()) for p, (lo, hi) in enumerate(zip(ends, ends[1:])) if lo < hi]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "run", "keys", "counts"])

        for b in batches:
            for pid, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if pid >> RUN_BITS != at:
                    yield from flush()
                    at, held = pid >> RUN_BITS, []
                # Shingles are distinct in a text; the lower bits of their hashes are not needed to tell them apart.
                held.append((shingled(words.of(text))[0] >> np.uint64(64 - KEY_BITS), n))
        yield from flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            each = [unpacked(x) for x in group.column("keys").to_pylist()]
            counts = [np.frombuffer(c, "<i8") if c else np.ones(len(k), np.int64) for k, c in zip(each, group.column("counts").to_pylist(), strict=True)]
            keys, sums = summed(np.concatenate(each), np.concatenate(counts))
            keys, codes = keys[sums > 1], codes_of(sums[sums > 1])
            part, rows = group.column("part")[0].as_py(), []
            for run, mine in zip(group.column("run").to_pylist(), each, strict=True):
                at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
                hit = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
                if hit.any():
                    rows.append((run, part, packed(mine[hit]), codes[at[hit]].tobytes()))
            for k in range(0, len(rows), 200):
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 200], strict=True), kinds, strict=True)], names=["run", "part", "keys", "codes"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = texts.select("pid", "n", "text").mapInArrow(count, "part long, run long, keys binary, counts binary")
    return counted.repartition(n, "part").sortWithinPartitions("part", "run").mapInArrow(total, "run long, part long, keys binary, codes binary")


def with_frequencies(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``run, kind, place, text, keys, codes`` sorted by run: first the frequencies of the run, then its texts, whose place is their pid."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = F.shiftright("pid", RUN_BITS).alias("run")
    none = F.lit(None).cast("binary")
    rows = texts.select(run, F.lit(1).alias("kind"), F.col("pid").alias("place"), "text", none.alias("keys"), none.alias("codes"))
    both = found.select("run", F.lit(0).alias("kind"), F.col("part").alias("place"), F.lit(None).cast("string").alias("text"), "keys", "codes").union(rows)
    return both.repartition(n, "run").sortWithinPartitions("run", "kind", "place")


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """From rows of with_frequencies: lists of ``(pid, shingles, times in the text, codes of document frequencies)``."""
    words, run, keys, codes = WordHashes(), None, [], []
    table: tuple[np.ndarray, np.ndarray] | None = None
    for b in batches:
        out = []
        for r, kind, place, text, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if r != run:
                run, keys, codes, table = r, [], [], None
            if not kind:
                keys.append(unpacked(k))
                codes.append(np.frombuffer(c, np.uint8))
                continue
            if table is None:
                every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
                # Parts ascend; a run that two tasks counted has some twice.
                order = np.argsort(every, kind="stable")
                table = every[order], np.concatenate(codes)[order] if keys else np.empty(0, np.uint8)
            ids, times = shingled(words.of(text))
            code = np.zeros(len(ids), np.uint8)
            if len(table[0]) and len(ids):
                mine = ids >> np.uint64(64 - KEY_BITS)
                at = np.minimum(np.searchsorted(table[0], mine), len(table[0]) - 1)
                code = np.where(table[0][at] == mine, table[1][at], np.uint8(0))
            out.append((place, ids, times, code))
        if out:
            yield out
