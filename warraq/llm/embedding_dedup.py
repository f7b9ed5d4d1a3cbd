"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components.

Vectors that are equal in every component are one point with a multiplicity. The signs of a point's
products with 256 random hyperplanes are its sketch, and each of several tables takes some of these
signs as its key. Tables hold keys, ids and sketches only: points of one key whose sketches
differ in few signs are candidates, of which each bucket hands on a spanning forest. Vectors are
fetched once, for the connected components of these candidates, and compared exactly there: all
pairs of a component, or, in a large one that is mostly far apart, the pairs of its buckets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from warraq.llm.common import components, discard, groups, ship, stored

#: Points that are compared as one block; larger buckets and components are dealt into pairs of blocks.
BLOCK = 4096
SIGNS = 256
WORDS = tuple(f"s{k}" for k in range(SIGNS // 64))
#: Points that share a key on average if directions are spread evenly.
BUCKET = 256


def plan(n: int, cosine: float, recall: float, bucket: int = BUCKET) -> tuple[int, int, int]:
    """Signs per key, tables, and the most signs in which candidates differ, so that a pair at the threshold is found with probability ``recall``."""
    bits = min(48, max(0, math.ceil(math.log2(max(1, n) / bucket))))
    p = math.acos(min(1.0, cosine)) / math.pi
    chance = [math.comb(SIGNS, d) * p**d * (1 - p) ** (SIGNS - d) for d in range(SIGNS + 1)]
    share = [math.comb(SIGNS - d, bits) / math.comb(SIGNS, bits) for d in range(SIGNS + 1)]
    most, seen = 0, chance[0]
    while 1 - seen > (1 - recall) / 4 and most < SIGNS:
        most += 1
        seen += chance[most]
    tables = 1
    while sum(chance[d] * (1 - (1 - share[d]) ** tables) for d in range(most + 1)) < recall:
        tables += 1
    return bits, tables, most


def masks(bits: int, tables: int, seed: int) -> np.ndarray:
    """The signs of each table's key, as words of 64."""
    rng = np.random.default_rng([seed, bits])
    chosen = np.zeros((tables, SIGNS), np.uint8)
    for t in range(tables):
        chosen[t, rng.choice(SIGNS, bits, replace=False)] = 1
    return np.packbits(chosen, axis=1, bitorder="little").view(np.int64)


def units(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their lengths in doubles, and which rows are neither zero nor hold a component that is not finite."""
    v = values.astype(np.float64)
    top = np.abs(v).max(axis=1, initial=0)
    good = np.isfinite(v).all(axis=1) & (top > 0)
    v = np.where(good[:, None], v, 0) / np.where(good, top, 1)[:, None]
    return v / np.where(good, np.sqrt(np.einsum("ij,ij->i", v, v)), 1)[:, None], good


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of the vectors of each length that hold no null."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = vectors.offsets.to_numpy()[:-1]
    child = vectors.values
    bad = np.zeros(len(child) + 1, np.int64)
    if child.null_count:
        bad[1:] = np.cumsum(child.is_null().to_numpy(zero_copy_only=False))
    values = child.fill_null(0).to_numpy(zero_copy_only=False) if child.null_count else child.to_numpy(zero_copy_only=False)
    whole = bad[starts + sizes] == bad[starts]
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero((sizes == d) & whole)
        yield at, values[starts[at][:, None] + np.arange(d)]


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place reaches, after edges a-b are added to ``root``."""
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signs in which each of a's sketches differs from each of b's."""
    return sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.uint16) for k in range(a.shape[1]))


def _chunks(n: int, m: int, start: int) -> Iterator[tuple[int, int]]:
    """Rows of the left side in turn, few enough that a chunk against m columns stays small."""
    step = max(16, (1 << 20) // max(1, m - start))
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)


def forest(sketches: np.ndarray, n: int, start: int, most: int) -> np.ndarray:
    """Roots of a spanning forest of candidates between the first ``n`` rows and the rows from ``start``."""
    root = np.arange(len(sketches))
    for lo, hi in _chunks(n, len(sketches), start):
        i, j = np.nonzero(distance(sketches[lo:hi], sketches[start:]) <= most)
        i, j = i + lo, j + start
        apart = root[i] != root[j]
        if apart.any():
            root = joined(root, i[apart], j[apart])
    return root


def compare(vec: np.ndarray, mult: np.ndarray, sketches: np.ndarray, n: int, start: int, earlier: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and roots of rows, from all pairs between the first ``n`` rows and those from ``start`` that share no key of the ``earlier`` masks."""
    m = len(vec)
    links, root = np.zeros(m, np.int64), np.arange(m)
    for lo, hi in _chunks(n, m, start):
        s = vec[lo:hi] @ vec[start:].T
        near = s >= cosine
        # A product that rounding may have put on either side is summed once more.
        i, j = np.nonzero(np.abs(s - cosine) < 1e-9)
        near[i, j] = np.einsum("ij,ij->i", vec[i + lo], vec[j + start]) >= cosine
        if not start:
            near[np.arange(hi - lo), np.arange(lo, hi)] = False
        for mask in earlier:
            near &= sum((sketches[lo:hi, None, k] ^ sketches[None, start:, k]) & w != 0 for k, w in enumerate(mask)) > 0
        links[lo:hi] += near @ mult[start:]
        if start:
            links[start:] += mult[lo:hi] @ near
        i, j = np.nonzero(near)
        i, j = i + lo, j + start
        apart = root[i] != root[j]
        if apart.any():
            root = joined(root, i[apart], j[apart])
    return links, root


def _dealt(rows: DataFrame, *unit: str) -> DataFrame:
    """Rows of units of two or more, each with ``own`` and, once per pair of blocks that it is in, ``lo`` and ``hi``."""
    sizes = rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(*unit, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")
    sent = rows.join(sizes, list(unit)).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sent.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")


def _in_blocks(rows: DataFrame, *unit: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *unit, "lo", "hi").sortWithinPartitions(*unit, "lo", "hi", "own", "pid")


def _sides(block: pa.RecordBatch) -> tuple[int, int]:
    """Rows of the left side, and the first row of the right; 0: all pairs within."""
    lo, hi = block.column("lo")[0].as_py(), block.column("hi")[0].as_py()
    n = int(np.count_nonzero(block.column("own").to_numpy() == lo))
    return n, 0 if lo == hi else n


def _sketches(block: pa.RecordBatch) -> np.ndarray:
    return np.stack([block.column(k).to_numpy() for k in WORDS], axis=1).view(np.uint64)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of cosine >= ``cosine`` and their connected components, one row per row of vectors.

    Returns ``vec_id, n_links, component_id, kept``. Vectors that are null, empty, zero or hold null
    or non-finite components, and those of a length of their own, link with nothing. Rows that repeat
    a vector are links of each other; rows that repeat an id are vectors of their own. A row with a
    null id is linked as any other and never gives the component its id, which is null where no
    row of it has one. An empty table gives no rows; other columns are not read. Keys get longer with the number of
    points and tables more with the keys, so that buckets and recall stay as they are. Work in a component
    grows with the pairs that are near in it, since links are counted exactly.
    """
    spark = ship(vectors.sparkSession)
    kind = vectors.schema[vector_col].dataType
    item = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{item}>").alias("v"))

    def rows_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        for at, values in by_length(b.column(1)):
            unit, good = units(values)
            at, values = at[good], np.ascontiguousarray(values[good])
            yield at, values, unit[good], [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in values]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            same, dim, signs = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, len(WORDS)), np.int64)
            for at, values, unit, digests in rows_of(b):
                d = values.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, SIGNS))
                same[at], dim[at] = digests, d
                signs[at] = np.packbits(unit @ planes[d] >= 0, axis=1, bitorder="little").view(np.int64)
            columns = [b.column(0), pa.array(same.tolist(), pa.binary()), pa.array(dim), *(pa.array(signs[:, k]) for k in range(len(WORDS)))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "same", "dim", *WORDS])

    rows = stored(read.mapInArrow(sketched, "vec_id long, same binary, dim int" + "".join(f", {w} long" for w in WORDS)), "signs")
    one = rows.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), *(F.first(c).alias(c) for c in ("dim", *WORDS)))
    points = stored(one.withColumn("pid", F.monotonically_increasing_id()), "points")
    bits, tables, most = plan(points.count(), cosine, recall)
    taken = masks(bits, tables, seed)

    def key(t: int) -> Column:
        return F.xxhash64(F.lit(t), "dim", *(F.col(w).bitwiseAND(F.lit(int(mask))) for w, mask in zip(WORDS, taken[t], strict=True)))

    keys = F.posexplode(F.array(*(key(t) for t in range(tables)))).alias("tab", "key")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, 3):
            n, start = _sides(block)
            pid = block.column("pid").to_numpy()
            root = forest(_sketches(block), n, start, most)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(pid[at]), pa.array(pid[root[at]])], names=["a", "b"])

    near = _in_blocks(_dealt(points.select("pid", *WORDS, keys).drop("tab"), "key"), "key").select("key", "lo", "hi", "own", "pid", *WORDS)
    loose = components(near.mapInArrow(linked, "a long, b long"), "loose")
    sizes = loose.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("n"))
    member = points.join(loose, F.col("pid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "pid")).drop("node")
    members = stored(member.join(sizes, "component").select("component", "n", "pid", "mult", "same", "dim", *WORDS), "members")
    # A large component that is far apart, as a long chain, takes fewer pairs by its buckets.
    big = members.where(F.col("n") > BLOCK).select("component", "n", "pid", "mult", "same", *WORDS, keys)
    pairs = big.groupBy("component", "n", "tab", "key").count().groupBy("component", "n").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"))
    thin = stored(pairs.where(F.col("pairs") < F.col("n").cast("double") * F.col("n")).select("component"), "thin")
    slim = ["tab", "unit", "pid", "mult", "same", *WORDS]
    whole = members.join(thin, "component", "left_anti").select(F.lit(-1).alias("tab"), F.col("component").alias("unit"), *slim[2:])
    cut = big.join(thin, "component", "left_semi").select("tab", F.xxhash64("component", "key").alias("unit"), *slim[2:])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, values, _, digests in rows_of(b):
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in values], pa.binary())], names=["same", "raw"])

    raw = read.mapInArrow(fetched, "same binary, raw binary").dropDuplicates(["same"])
    sent = _dealt(whole.union(cut), "tab", "unit").join(raw, "same")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, 4):
            n, start = _sides(block)
            if start == block.num_rows or not n:
                continue
            pid, mult, tab = block.column("pid").to_numpy(), block.column("mult").to_numpy(), block.column("tab")[0].as_py()
            values = np.frombuffer(b"".join(block.column("raw").to_pylist()), np.float32 if item == "float" else np.float64).reshape(block.num_rows, -1)
            links, root = compare(units(values)[0], mult, _sketches(block), n, start, taken[: max(tab, 0)].view(np.uint64), cosine)
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(pid[at]), pa.array(links[at]), pa.array(pid[root[at]])], names=["pid", "n", "root"])

    blocks = _in_blocks(sent, "tab", "unit").select("tab", "unit", "lo", "hi", "own", "pid", "mult", *WORDS, "raw")
    found = stored(blocks.mapInArrow(counted, "pid long, n long, root long"), "links")
    exact = components(found.select(F.col("pid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("pid").agg(F.sum("n").alias("n"))
    of = points.select("pid", "same", "rep", "mult").join(exact, F.col("pid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "pid")).join(links, "pid", "left")
    least = of.where("n is not null").groupBy("component").agg(F.min("rep").alias("component_id"))
    point = of.join(least, "component", "left").select("same", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    alone = F.col("same").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    out = rows.select("vec_id", "same").join(point, "same", "left")
    out = stored(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")), "vectors")
    discard(rows, points, loose, members, thin, found, exact)
    return out
