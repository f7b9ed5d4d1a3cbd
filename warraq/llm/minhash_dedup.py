"""Near-duplicate documents by consistent weighted sampling.

Each shingle of five words weighs its number of times in the text by its inverse document frequency.
Improved consistent weighted sampling draws, for each of several samples, one shingle of a text
such that two texts draw the same with the probability of their weighted Jaccard similarity.
A large group of copies makes its own shingles frequent, and every edit in it rare: the more
documents there are, the less alike its members seem by such weights. So as many samples are drawn
by counts alone. Samples are cut into bands; texts that share a band of either kind are candidates, and
weighted Jaccard over whole texts decides, by either weights. Within a band's group every member is compared with the least member; while the group is in several parts, every candidate pair outside the largest is
compared too, one member against a block of others at a time. Equal texts are one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.common import components, discard, ship, stored, whole
from warraq.llm.shingles import Block, WordHashes, coded, document_frequencies, inverse_frequencies, jaccards, mixed, shingled, with_frequencies

BANDS, ROWS = 14, 4
THRESHOLD = 0.8
#: Least similarity by counts alone that links: below it, texts may have in common what many documents hold.
COPIES = 0.8
#: Members of a group that are held against at a time.
BLOCK = 512
#: Members of a group that a task compares with its least member.
SHARE = 1024
#: Triples of random variates, as a power of two.
TABLE_BITS = 16
#: Shingles that are drawn from at a time.
STEP = 512


class Sampler:
    """Consistent samples of a weighted set; the random variates of (shingle, sample) come from a table indexed by a hash."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << TABLE_BITS
        self.odd = (rng.integers(0, 1 << 63, samples, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
        self.r = rng.gamma(2, 1, n)
        self.log_c = np.log(rng.gamma(2, 1, n))
        self.beta = rng.random(n)
        # ln a of a shingle of weight w lies between log_c - r - ln w and log_c - ln w.
        self.least = (self.log_c - self.r).astype(np.float32)
        # Products of 32 bits are the faster; two shingles of a text seldom share the upper half of their hashes.
        self.half = (self.odd >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.place, self.at, self.bound = np.empty(samples * STEP, np.uint32), np.empty(samples * STEP, np.int64), np.empty(samples * STEP, np.float32)

    def draw(self, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit mark of the drawn (shingle, quantised weight) per sample.

        The value of a shingle is worked out only where its lower bound is below the value of the one with the least bound.
        """
        log_w = np.log(weights)
        low_w = log_w.astype(np.float32)
        samples = len(self.odd)
        every = np.arange(samples)
        limit = np.full(samples, np.inf)
        found = []
        for lo in range(0, len(ids), STEP):
            some = ids[lo : lo + STEP]
            n = len(some)
            # The same memory for each stretch, which stays in the cache.
            place, bound = self.place[: samples * n].reshape(samples, n), self.bound[: samples * n].reshape(samples, n)
            np.multiply(self.half, (some >> np.uint64(32)).astype(np.uint32), out=place)
            np.right_shift(place, np.uint32(32 - TABLE_BITS), out=place)
            at = self.at[: samples * n].reshape(samples, n)
            np.copyto(at, place)
            np.take(self.least, at, out=bound, mode="clip")
            bound -= low_w[lo : lo + n]
            first = bound.argmin(axis=1)
            value, _ = self._value(at[every, first], log_w[lo + first])
            limit = np.minimum(limit, value)
            hit = np.flatnonzero(bound <= (limit + 1e-4).astype(np.float32)[:, None])
            s, i = hit // n, hit % n
            value, level = self._value(at.ravel()[hit], log_w[lo + i])
            low = value <= limit[s]
            found.append((s[low], lo + i[low], value[low], level[low]))
        s, i, value, level = map(np.concatenate, zip(*found, strict=True))
        least = np.full(samples, np.inf)
        np.minimum.at(least, s, value)
        keep = np.flatnonzero(value == least[s])
        # Shingles that share an entry of the table and a weight tie; a hash of each and the sample decides.
        tie = mixed(ids[i[keep]] ^ self.odd[s[keep], 0])
        order = keep[np.lexsort((tie, s[keep]))]
        first = order[np.searchsorted(s[order], every)]
        return mixed(ids[i[first]] + level[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _value(self, place: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and the quantised weight."""
        r, beta = self.r[place], self.beta[place]
        t = np.floor(log_w / r + beta)
        return self.log_c[place] - r * (t - beta + 1), t


class Minima:
    """Least hashes of a text's shingles, the k-th time of each being an element of its own: equal with the probability of the Jaccard similarity by counts."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11):
        self.odd = np.random.default_rng(seed).integers(0, 1 << 32, samples, np.uint32)[:, None] | np.uint32(1)
        self.product = np.empty(samples * STEP, np.uint32)

    def draw(self, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        each = (mixed(np.repeat(ids, times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.odd), (1 << 32) - 1, np.uint32)
        for lo in range(0, len(each), STEP):
            some = each[lo : lo + STEP]
            product = self.product[: len(self.odd) * len(some)].reshape(len(self.odd), len(some))
            np.minimum(least, np.multiply(self.odd, some, out=product).min(axis=1), out=least)
        return least.astype(np.uint64)


def band_keys(marks: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band, which tells bands apart."""
    m = marks.reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(m.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + m[:, k])
    return h.view(np.int64)


def _sketches(texts: DataFrame, documents: int, chars: int, bands: int, rows: int) -> DataFrame:
    """``pid, keys, codes``: a text's bands by TF-IDF and then by counts, and its shingles' document frequencies in the order of their hashes."""
    idf = inverse_frequencies(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, minima = Sampler(bands * rows), Minima(bands * rows)

        def keys(ids: np.ndarray, times: np.ndarray, code: np.ndarray) -> list[int]:
            return band_keys(np.concatenate([sampler.draw(ids, times * idf[code]), minima.draw(ids, times)]), 2 * bands).tolist() if len(ids) else []

        for some in coded(batches):
            out = [(pid, keys(ids, times, code), code.tobytes()) for pid, ids, times, code in some]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["pid", "keys", "codes"])

    found = stored(document_frequencies(texts, chars), "frequencies")
    out = stored(with_frequencies(texts, found).mapInArrow(run, "pid long, keys array<long>, codes binary"), "sketches")
    discard(found)
    return out


def _weights(words: WordHashes, text: str, codes: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, their weights and their counts."""
    ids, times = shingled(words.of(text))
    return ids, times * idf[np.frombuffer(codes, np.uint8)], times.astype(float)


def _linked(likeness: list, threshold: float):
    """Whether similarities by TF-IDF and by counts, numbers or arrays, make a link."""
    weighted, counted = likeness
    return (weighted >= threshold) | (counted >= max(threshold, COPIES))


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs ``(a, lead)`` whose similarity over whole texts makes a link, as ``(a, b)``.

    The members of a lead are dealt into shares; each has the lead's text once, and then theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, theirs = WordHashes(), None
        for batch in batches:
            out = []
            for lead, _, member, a, text, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = _weights(words, text, codes, idf)
                if not member:
                    theirs = mine
                elif _linked(jaccards(mine, theirs), threshold):
                    out.append((a, lead))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sizes = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    member = pairs.join(sizes, "lead").select("lead", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("member"), "a")
    lead = sizes.select("lead", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("member"), F.col("lead").alias("a"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = member.union(lead).join(texts.select(F.col("pid").alias("a"), "text", "codes"), "a").select("lead", "share", "member", "a", "text", "codes")
    return both.repartition(n, "lead", "share").sortWithinPartitions("lead", "share", "member").mapInArrow(run, "a long, b long")


def _apart(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of groups that are in several parts: ``key, pid, part, outside`` the group's largest part, ``n`` in the group."""
    part = members.join(parts, F.col("pid") == F.col("node"), "left").select("key", "n", "pid", F.coalesce("component", "pid").alias("part"))
    sizes = part.groupBy("key", "part").count().groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("count", "part")).alias("main")).where("parts > 1")
    return part.join(sizes, "key").select("key", "n", "pid", "part", (F.col("part") != F.col("main")).alias("outside"))


def _rest(apart: DataFrame, sketches: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links between members of a group that are still in different parts, by comparison of each such pair until its parts join.

    A group is dealt into blocks of bounded size, and members outside its largest part are sent to
    each block. A pair that shares several keys is compared under the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, held, out = WordHashes(), None, [], []

        def flush() -> None:
            roots: dict[int, int] = {}

            def root(x: int) -> int:
                while x in roots:
                    x = roots[x]
                return x

            here = [r for r in held if r[0]]
            if not here:
                return
            keys = np.array([r[3] for r in here], np.int64)
            block = Block([_weights(words, r[4], r[5], idf) for r in here])
            for _, pid, part, own, text, codes in (r for r in held if not r[0]):
                first = (keys == np.array(own, np.int64)).argmax(axis=1) == own.index(at[0])
                for i in np.flatnonzero(first & _linked(block.jaccards(_weights(words, text, codes, idf)), threshold)).tolist():
                    x, y = root(part), root(here[i][2])
                    if x != y:
                        roots[max(x, y)] = min(x, y)
                        out.append((pid, here[i][1]))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != at:
                    flush()
                    at, held = row[:2], []
                held.append(row[2:])
            if out:
                yield batch()
                out = []
        flush()
        if out:
            yield batch()

    spark = apart.sparkSession
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    inside = apart.select("key", F.pmod(F.xxhash64("pid"), blocks).cast("int").alias("block"), F.lit(True).alias("inside"), "pid", "part")
    outside = apart.where("outside").select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(False).alias("inside"), "pid", "part")
    rows = inside.union(outside).join(sketches.select("pid", "keys"), "pid").join(texts.select("pid", "text", "codes"), "pid")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "block", "inside", "pid", "part", "keys", "text", "codes").repartition(n, "key", "block").sortWithinPartitions("key", "block", "inside", "pid")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate documents: ``doc_id, class_id, kept`` per row of docs.

    Links are equal texts and pairs of weighted Jaccard similarity >= ``threshold`` over five-word
    shingles, weighted by count and inverse document frequency, which is counted over all rows; also pairs that reach it, and 0.8, by
    counts alone, since a large group of copies makes its own shingles frequent. A class is a connected component and its id the least doc_id. A null text is empty; texts without words link with equal texts only, and those of
    fewer than five words are one shingle. Rows that share a doc_id are one document, whose texts are linked. Rows
    with a null id count in the frequencies, link with nothing and are kept. Very long texts are read whole.
    An empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("same", F.md5("text"))
    one = named.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    texts = stored(one.withColumns({"chars": F.char_length("text"), "pid": F.monotonically_increasing_id()}), "texts")
    size = texts.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    documents, chars = size["n"] or 0, size["chars"] or 0
    idf = inverse_frequencies(documents)
    sketches = _sketches(texts.select("pid", "n", "text"), documents, chars, bands, rows)

    # Texts that no row with an id has link with nothing.
    used = texts.where("rep is not null").select("pid")
    keyed = sketches.join(used, "pid", "left_semi").select("pid", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.min("pid").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keyed.join(groups, "key"), "members")
    # Sort-merge at every size: the ids grow with the documents, and a plan that changes with them would hide it.
    used = members.select("pid").distinct().hint("merge")
    candidates = stored(texts.select("pid", "text").join(used, "pid").join(sketches.select("pid", "codes"), "pid"), "candidates")
    pairs = stored(members.where("pid <> lead").select(F.col("pid").alias("a"), "lead").distinct(), "pairs")
    near = stored(_verified(pairs, candidates, idf, threshold), "near")
    first_parts = components(near)
    apart = stored(_apart(members, first_parts), "apart")
    more = stored(_rest(apart, sketches, candidates, idf, threshold), "near")

    ids = named.select("doc_id", "same").join(texts.select("same", "pid"), "same").select("doc_id", "pid")
    ids = stored(ids, "ids")
    first = ids.where("doc_id is not null").groupBy("doc_id").agg(F.min("pid").alias("a"), F.max("pid").alias("last")).where("a < last").select("doc_id", "a")
    shared = ids.join(first, "doc_id").select("a", F.col("pid").alias("b")).distinct()
    parts = components(near.union(more).union(shared))
    part = texts.select("pid", "rep").join(parts, F.col("pid") == F.col("node"), "left").select("pid", "rep", F.coalesce("component", "pid").alias("part"))
    least = part.groupBy("part").agg(F.min("rep").alias("class_id"))
    classes = part.join(least, "part").select("pid", "class_id")
    class_id = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    out = ids.join(classes, "pid", "left").select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))
    out = stored(out, "classes")
    discard(texts, sketches, members, candidates, pairs, near, first_parts, apart, more, ids, parts)
    return out
