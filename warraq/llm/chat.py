"""Quotation linking: messages without their quotes, in the order of replies.

Lines that begin with ``>`` are quotes, nested by the number of marks. Consecutive quoted lines of one
level are a passage, whatever their breaks. A passage of eight words or more is hashed as winnowed
windows of five words, so that it is found in a longer message, and a shorter one as a whole, to be found as
a line, sentence or paragraph. Each hash is joined to the nearest earlier message of the conversation
that wrote it, and to the first in another one; the passage belongs to the one of these messages that holds most of
its hashes, half of them at least, and the message that the outermost passages belong to is replied to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.llm.common import discard, ship, stored, whole
from warraq.llm.shingles import MULTIPLIERS, WIDTH, WordHashes, mixed, words_of

QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
#: A line that introduces a quote: it goes with the quote below it.
INTRODUCES = re.compile(r"^(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*$", re.I)
PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"(?<=[.!?…؟。！？])\s+")
#: Of so many windows in a row one is a hash at least.
WINNOW = 4
#: A passage of fewer words is hashed as a whole.
SHORT = WIDTH + WINNOW - 1
#: A passage of fewer words is not looked for in other conversations.
OUTSIDE_WORDS = 5
#: Turns of a conversation that are searched together for the nearest writer.
PART = 1024


def split(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The lines that are not quoted, and the quoted passages with their levels."""
    own: list[str] = []
    passages: list[tuple[int, str]] = []
    last = 0
    for line in text.split("\n"):
        if m := QUOTE.match(line):
            k = next((k for k in range(len(own) - 1, -1, -1) if own[k].strip()), None)
            if not last and k is not None and INTRODUCES.match(own[k].strip()):
                del own[k:]
            level = m[1].count(">")
            if not m[2].strip():
                last = -1
            elif level == last:
                passages[-1] = (level, passages[-1][1] + "\n" + m[2])
            else:
                passages.append((level, m[2]))
                last = level
        else:
            own.append(line)
            last = 0
    return own, passages


class Hashes:
    """Hashes of passages and of what a message may be quoted by."""

    def __init__(self):
        self.words = WordHashes()

    @staticmethod
    def one(words: list[str]) -> int:
        """One hash of all the words."""
        return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)

    @staticmethod
    def winnowed(words: np.ndarray) -> list[int]:
        """Hashes of windows of five words that are the least of four in a row."""
        n = len(words) - WIDTH + 1
        h = sum(words[k : k + n] * np.uint64(MULTIPLIERS[k]) for k in range(WIDTH))
        h = mixed(h).view(np.int64)
        least = h[: n - WINNOW + 1]
        for k in range(1, WINNOW):
            least = np.minimum(least, h[k : n - WINNOW + 1 + k])
        return list(set(least.tolist()))

    def passage(self, text: str) -> tuple[list[int], bool]:
        """The hashes to look for, and whether other conversations are searched."""
        words = words_of(text)
        if not words:
            return [], False
        return (self.winnowed(self.words.of(text)) if len(words) >= SHORT else [self.one(words)]), len(words) >= OUTSIDE_WORDS

    def written(self, own: list[str]) -> list[int]:
        """Hashes by which a message may be quoted."""
        text = "\n".join(own)
        words = words_of(text)
        out = set(self.winnowed(self.words.of(text))) if len(words) >= SHORT else set()
        for piece in {*text.split("\n"), *SENTENCE.split(text), *PARAGRAPH.split(text)}:
            if len(few := words_of(piece)) < SHORT and few:
                out.add(self.one(few))
        return list(out)


def cleaned(text: str, own: list[str], quoted: bool) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if quoted else text


READ = "conv_id long, turn long, role string, text string, written array<long>, passages array<struct<level: int, outside: boolean, keys: array<long>>>"


def link(messages: DataFrame) -> DataFrame:
    """One row per message: its text without quotes, the message it replies to and its place in the thread.

    Columns: ``conv_id, turn, role, text, parent_conv, parent_turn, root_conv, root_turn, depth, position,
    n_quoted, n_linked``, the last two counts of passages. A thread is the rows of one root by
    ``position``, in which a reply comes after the message it replies to: by depth, conversation and turn. A null
    text is empty. Messages without a quote that links have null parent and are roots; of messages that
    quote each other in a ring the least is the root of all that hang on it, though it has a parent. A message that ties with
    another in the hashes of a passage loses to the nearer one of the conversation, or to the first elsewhere. Passages of
    fewer than five words are looked for in their own conversation only. Rows with a null conv_id or turn
    are cleaned but neither link nor are linked to, and are their own roots. Rows that repeat a message get the same
    links. Other columns are not read; an empty table gives no rows. Writers are reduced to one for each hash and quote before they meet, so a line that
    many messages share joins no group to a group.
    """
    ship(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        kinds = [pa.list_(pa.int64()), pa.list_(pa.struct([("level", pa.int32()), ("outside", pa.bool_()), ("keys", pa.list_(pa.int64()))]))]
        for b in batches:
            texts, written, found = [], [], []
            for text in b.column(3).to_pylist():
                own, passages = split(text)
                texts.append(cleaned(text, own, bool(passages) or len(own) <= text.count("\n")))
                written.append(hashes.written(own))
                some = [(level, *hashes.passage(p)) for level, p in passages]
                found.append([{"level": level, "outside": outside, "keys": keys} for level, keys, outside in some if keys])
            columns = [*(b.column(k) for k in range(3)), pa.array(texts, pa.string()), pa.array(written, kinds[0]), pa.array(found, kinds[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "written", "passages"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), whole("text").alias("text"))
    read = stored(rows.mapInArrow(run, READ), "messages")
    named = read.where("conv_id is not null and turn is not null")
    at = named.where(F.size("passages") > 0).select("conv_id", "turn", F.posexplode("passages").alias("at", "p"))
    quotes = stored(at.select("conv_id", "turn", "at", "p.level", "p.outside", F.size("p.keys").alias("n_keys"), F.explode("p.keys").alias("key")).distinct(), "quotes")
    # Only hashes that some message quotes are looked up.
    written = named.select("conv_id", "turn", F.explode("written").alias("key")).join(quotes.select("key").distinct(), "key", "left_semi")
    written = stored(written.distinct(), "written")
    near = nearest_writers(quotes, written)
    far = first_writers(written)
    found = quotes.join(near, ["conv_id", "key", "turn"], "left").join(far, "key", "left")
    elsewhere = F.when(F.col("outside"), F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second")))
    in_place = F.when(F.col("writer").isNotNull(), F.struct("conv_id", F.col("writer").alias("turn")))
    each = ["conv_id", "turn", "at"]
    candidates = found.select(*each, F.explode(F.array(in_place, elsewhere)).alias("origin")).where("origin is not null").distinct()
    here = F.col("origin.conv_id") == F.col("conv_id")
    # The nearer one of the conversation, or the first elsewhere.
    order = F.struct("n", here.alias("here"), F.when(here, F.col("origin.turn")).otherwise(-F.col("origin.conv_id")).alias("near"), (-F.col("origin.turn")).alias("early"))
    # How many hashes of the passage each candidate holds, not only those for which it is the nearest.
    held = candidates.join(quotes, each).join(written.select(F.struct("conv_id", "turn").alias("origin"), "key"), ["origin", "key"])
    votes = held.groupBy(*each, "level", "n_keys", "origin").agg(F.count(F.lit(1)).alias("n"))
    linked = votes.where("2 * n >= n_keys").groupBy("conv_id", "turn", "at", "level").agg(F.max_by("origin", order).alias("origin"), F.max("n").alias("n"))
    linked = stored(linked, "linked")
    outermost = linked.groupBy("conv_id", "turn").agg(F.min("level").alias("level"))
    by_origin = linked.join(outermost, ["conv_id", "turn", "level"]).groupBy("conv_id", "turn", "origin").agg(F.sum("n").alias("n"))
    parents = stored(by_origin.groupBy(F.struct("conv_id", "turn").alias("id"), "conv_id").agg(F.max_by("origin", order).alias("parent")).select("id", "parent"), "parents")
    roots = threads(parents)
    counts = quotes.select("conv_id", "turn", "at", "level").distinct().groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quoted"))
    counts = counts.join(linked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked")), ["conv_id", "turn"], "left")
    me = F.struct("conv_id", "turn")
    out = read.drop("written", "passages").withColumn("me", me).join(counts.select(me.alias("me"), "n_quoted", "n_linked"), "me", "left")
    out = out.join(roots.withColumnRenamed("id", "me"), "me", "left")
    out = stored(
        out.select(
            "conv_id", "turn", "role", "text",
            F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
            F.coalesce("root.conv_id", "conv_id").alias("root_conv"), F.coalesce("root.turn", "turn").alias("root_turn"),
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("depth", "position", "n_quoted", "n_linked")),
        ), "links",
    )
    discard(read, quotes, written, linked, parents, roots)
    return out


def nearest_writers(quotes: DataFrame, written: DataFrame) -> DataFrame:
    """``conv_id, key, turn, writer``: the last turn before each quote that wrote the key in its conversation.

    Turns are searched in parts, and the last writer of each part is carried on to the next ones.
    """
    asked = quotes.select("conv_id", "key", "turn", F.lit(None).cast("long").alias("writer")).distinct()
    part = F.floor(F.col("turn") / PART).alias("part")
    both = written.select("conv_id", "key", "turn", F.col("turn").alias("writer")).union(asked).select("*", part)
    # A quote sorts before what is written in its own turn.
    inside = Window.partitionBy("conv_id", "key", "part").orderBy("turn", F.col("writer").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("inside", F.last("writer", ignorenulls=True).over(inside)).where("writer is null")
    before = Window.partitionBy("conv_id", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("conv_id", "key", "part").agg(F.max("writer").alias("top")).withColumn("carried", F.last("top", ignorenulls=True).over(before))
    out = found.join(carried.select("conv_id", "key", "part", "carried"), ["conv_id", "key", "part"])
    return out.select("conv_id", "key", "turn", F.coalesce("inside", "carried").alias("writer"))


def first_writers(written: DataFrame) -> DataFrame:
    """``key, first, second``: the first message that wrote a key, and the first of other conversations than that."""
    each = written.groupBy("key", "conv_id").agg(F.min("turn").alias("turn"))
    first = each.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    other = each.join(first, "key").where(F.col("conv_id") != F.col("first.conv_id")).groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    return first.join(other, "key", "left")


def doubled(parents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``id, top, depth`` by pointer doubling, and the distinct messages of rings, if there are any.

    After each round, pointers that can still move are counted by the messages they point to. Those of chains get
    fewer with every round; when their number stays, only rings are left.
    """
    cur, last = stored(parents.select("id", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moves")), "pointers"), -1
    while True:
        moving = cur.where("moves").select("top").distinct().join(parents.select(F.col("id").alias("top")), "top", "left_semi")
        n = moving.count()
        if not n or n == last:
            break
        last = n
        step = cur.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.lit(True).alias("stepped"))
        new = cur.join(step, "top", "left").select("id", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("stepped", F.lit(False)).alias("moves"))
        new = stored(new, "pointers")
        discard(cur)
        cur = new
    return cur, moving if n else None


def threads(parents: DataFrame) -> DataFrame:
    """``id, parent, root, depth, position`` of messages with a parent; a ring is cut at its least message."""
    cur, rings = doubled(parents)
    if rings is not None:
        heads = stored(ring_heads(parents.join(rings.withColumnRenamed("top", "id"), "id", "left_semi")), "heads")
        discard(cur)
        cur, _ = doubled(parents.join(heads, "id", "left_anti"))
    deep = parents.join(cur.select("id", "top", "depth"), "id", "left").select("id", "parent", F.coalesce("top", "id").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    out = stored(ranked(deep), "threads")
    discard(cur)
    return out


def ring_heads(ring: DataFrame) -> DataFrame:
    """The least message of each ring, ``id``."""
    cur = stored(ring.select("id", F.col("parent").alias("top"), F.least("id", "parent").alias("least")), "ring")
    while True:
        step = cur.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("least").alias("low"))
        new = cur.join(step, "top").select("id", F.col("next").alias("top"), F.least("least", "low").alias("least"), (F.col("low") < F.col("least")).alias("changed"))
        new = stored(new, "ring")
        changed = not new.where("changed").isEmpty()
        discard(cur)
        cur = new
        if not changed:
            return cur.where("id = least").select("id")


def ranked(deep: DataFrame) -> DataFrame:
    """Positions below a root by depth, conversation and turn; the root has 0. Ranked in parts of turns, on top of the parts before."""
    root = F.col("depth") == 0
    rows = deep.where(~root).withColumns({"conv": F.col("id.conv_id"), "part": F.floor(F.col("id.turn") / PART)})
    group = ["root", "depth", "conv", "part"]
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("root").orderBy("depth", "conv", "part")) - F.col("n")).drop("n")
    out = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("id"))).join(before, group)
    out = out.select("id", "parent", "root", "depth", (F.col("before") + F.col("nth")).alias("position"))
    return out.union(deep.where(root).select("id", "parent", "root", "depth", F.lit(0).cast("long")))
