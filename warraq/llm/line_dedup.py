"""Line dedup by pairwise alignment.

Documents are paired with the first document that holds one of their windows of lines, the least that
can be deleted, aligned with it by patience diff over line hashes, and lose the aligned common blocks.
What that leaves, as passages that are repeated or in another order, is matched once more by a suffix
automaton of the earlier document's lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.common import discard, ship, stored, whole
from warraq.llm.shingles import UNSPACED

#: Words of a line that a deleted block must hold.
ANCHOR_WORDS = 5
#: Words of an aligned block that is deleted.
BLOCK_WORDS = 20
#: Words of a line: runs without blanks, and each character of a script that has none between words.
WORDS = rf"[^\s{UNSPACED}]+|[{UNSPACED}]"
#: Alignments with one earlier document that a task takes together.
SHARE = 512
#: The polynomial by which windows of lines are hashed.
PRIME, BASE = (1 << 61) - 1, 0x1D2F3A4B5C6D7E9


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, whose second ascends (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        if at:
            back[k] = ends[at - 1]
        tops[at : at + 1] = [j]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks ``(start in a, start in b, length)`` of a patience alignment, ascending."""
    matched: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        while i < m and j < n and a[i] == b[j]:
            matched.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            matched.append((m, n))
        if i == m or j == n:
            continue
        left, right = Counter(a[i:m]), Counter(b[j:n])
        place = {b[k]: k for k in range(j, n) if right[b[k]] == 1}
        anchors = _ascending([(k, place[a[k]]) for k in range(i, m) if left[a[k]] == 1 and a[k] in place])
        if anchors:
            matched += anchors
            stops = [(i - 1, j - 1), *anchors, (m, n)]
            work += [(p + 1, x, q + 1, y) for (p, q), (x, y) in zip(stops, stops[1:]) if p + 1 < x and q + 1 < y]
    out: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if out and (i, j) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def longest_runs(a: list[int], b: list[int]) -> list[int]:
    """For each place of a, the length of the longest run of b that ends there (suffix automaton of b)."""
    following: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for x in b:
        new, p = len(size), last
        following.append({})
        size.append(size[last] + 1)
        link.append(0)
        while p >= 0 and x not in following[p]:
            following[p][x] = new
            p = link[p]
        if p >= 0:
            q = following[p][x]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(size)
                following.append(dict(following[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(x) == q:
                    following[p][x] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out, at, n = [], 0, 0
    for x in a:
        while at and x not in following[at]:
            at = link[at]
            n = size[at]
        at, n = (following[at][x], n + 1) if x in following[at] else (0, 0)
        out.append(n)
    return out


def repeated_blocks(mine: list[int], n_words: list[int], theirs: list[int], block_words: int = BLOCK_WORDS, anchor_words: int = ANCHOR_WORDS) -> list[tuple[int, int]]:
    """Blocks ``(first, end)`` of mine to delete: those of the alignment, and all that the stretches between them share with theirs."""
    words, anchors = [0, *accumulate(n_words)], [0, *accumulate(n >= anchor_words for n in n_words)]

    def enough(i: int, k: int) -> bool:
        return words[k] - words[i] >= block_words and anchors[k] > anchors[i]

    out = [(i, i + n) for i, _, n in patience(mine, theirs) if enough(i, i + n)]
    stops = [0, *(x for block in out for x in block), len(mine)]
    for i, k in zip(stops[::2], stops[1::2], strict=True):
        if i < k and enough(i, k):
            runs = [*longest_runs(mine[i:k], theirs), 0]
            out += [(i + e + 1 - n, i + e + 1) for e, n in enumerate(runs[:-1]) if n and runs[e + 1] != n + 1 and enough(i + e + 1 - n, i + e + 1)]
    return sorted(out)


def least_windows(lines: list[int], n_words: list[int], block_words: int = BLOCK_WORDS, anchor_words: int = ANCHOR_WORDS) -> set[int]:
    """Hashes of the shortest blocks that may be deleted, from each first line and to each last one.

    Every longer such block is covered by those in it.
    """

    def spans(words: list[int]) -> Iterator[tuple[int, int]]:
        total = anchors = end = 0
        for start in range(len(words)):
            while end < len(words) and (total < block_words or not anchors):
                total, anchors, end = total + words[end], anchors + (words[end] >= anchor_words), end + 1
            if total < block_words or not anchors:
                return
            yield start, end
            total, anchors = total - words[start], anchors - (words[start] >= anchor_words)

    m = len(lines)
    both = {*spans(n_words), *((m - k, m - i) for i, k in spans(n_words[::-1]))}
    sums, powers = [0], [1]
    for x in lines:
        sums.append((sums[-1] * BASE + x) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    return {(sums[k] - sums[i] * powers[k - i]) % PRIME for i, k in both}


def find_repeats(docs: DataFrame, anchor_words: int = ANCHOR_WORDS, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line ranges to delete: ``doc_id, same, removed array<struct<first, last>>`` (ends exclusive) of documents that have any.

    Lines are compared without blanks at their ends. ``same`` is the MD5 of the text, so that rows
    that share a doc_id but not the text keep their own ranges. Null ids are left out, a null text is empty, other
    columns are not read, and an empty table gives no rows. An earlier document that many others are aligned with is
    sent to several tasks.
    """
    ship(docs.sparkSession)
    split = F.split(F.col("text"), "\n")
    trimmed = F.transform(split, lambda x: F.trim(x))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).where("doc_id is not null")
    plain = F.transform(trimmed, lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+"))))
    words = F.when(F.col("text").rlike(f"[{UNSPACED}]"), F.transform(trimmed, lambda x: F.regexp_count(x, F.lit(WORDS)))).otherwise(plain)
    read = texts.select("doc_id", F.md5("text").alias("same"), F.transform(trimmed, lambda x: F.xxhash64(x)).alias("lines"), words.alias("words"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(least_windows(x, n, block_words, anchor_words)) for x, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=[*b.schema.names, "windows"])

    lines = stored(read.mapInArrow(hashed, "doc_id long, same string, lines array<long>, words array<int>, windows array<long>"), "lines")
    windows = lines.select("doc_id", F.explode("windows").alias("window"))
    first = windows.groupBy("window").agg(F.min("doc_id").alias("earlier"), F.max("doc_id").alias("latest")).where("earlier < latest")
    pairs = windows.join(first.select("window", "earlier"), "window").where("earlier < doc_id").select("doc_id", "earlier").distinct()
    pairs = stored(pairs, "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for mine, n_words, theirs in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                found.append([{"first": x, "last": y} for x, y in repeated_blocks(mine, n_words, theirs, block_words, anchor_words)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind)], names=["doc_id", "same", "removed"])

    # Of documents that share an id, each is aligned; the earlier one is any of its own texts.
    hot = pairs.groupBy("earlier").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    other = lines.groupBy(F.col("doc_id").alias("earlier")).agg(F.min_by("lines", "same").alias("theirs"))
    other = other.join(hot, "earlier").select("earlier", "theirs", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = pairs.join(hot, "earlier").select("doc_id", "earlier", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int").alias("share"))
    both = dealt.join(lines, "doc_id").join(other, ["earlier", "share"]).select("doc_id", "same", "lines", "words", "theirs")
    ranges = both.mapInArrow(run, "doc_id long, same string, removed array<struct<first: int, last: int>>").where(F.size("removed") > 0)
    out = stored(ranges.groupBy("doc_id", "same").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed")), "repeats")
    discard(lines, pairs)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with repeated blocks deleted from the later document's text, and ``removed``: the deleted line ranges.

    Later is of greater doc_id. A block is deleted if an earlier document holds it and it has 20 words
    or more and a line of five or more; other repeats stay. The first document that holds a block is
    never changed on its account. A null text stays null, an emptied one is "". Rows with
    a null id stay as they are; repeated rows get the same deletions; other columns pass through; an
    empty table gives no rows. Each character of a script without blanks is a word. ``removed`` of docs is replaced.
    """
    docs = docs.drop("removed")
    repeats = find_repeats(docs, id_col=id_col, text_col=text_col, **options).withColumnRenamed("removed", "ranges")
    # The row goes along as one column, so that its names meet none of ours.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.md5(whole(text_col)).alias("same"))
    # Sort-merge at every size: a plan that changes with the number of repeats would hide what it costs.
    joined = rows.join(repeats.hint("merge"), ["doc_id", "same"], "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.exists("ranges", lambda r: (i >= r["first"]) & (i < r["last"])))
    text = F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    plain = [F.col(f"row.`{c}`") if c != text_col else text.alias(text_col) for c in docs.columns]
    return joined.select(*plain, F.coalesce("ranges", F.expr("cast(array() as array<struct<first: int, last: int>>)")).alias("removed"))
