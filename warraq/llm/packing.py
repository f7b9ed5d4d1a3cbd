"""Packing of token sequences by online sum of squares.

Every document's ids are cut into full windows and a rest. A rest goes to the fill level that leaves
the least sum of squared counts of partially filled windows; the counts are kept in an array by
level. When a partition ends, or too many windows are open, those are merged: pieces of the emptiest
are cut to fill the gaps of the fullest, and what is left is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.common import ship, whole

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WINDOW = 2048
#: Fixed value: characters at which str.split() cuts but the tokenizer's white space does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Entries of the word cache of a worker before its older half is dropped.
CACHE = 700_000
#: Windows that are open at a time.
OPEN = 8192
#: A tokenizer whose ids of a text are those of its words in a row.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts as little-endian bytes, remembered by white-space delimited word.

    White space is dropped by the tokenizer and never joins two pre-tokens, so the ids of a text are
    those of its words in a row. Two generations of a dictionary bound the memory.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
            self.young[w] = np.array(e.ids, "<u4").tobytes()

    def _alphabetic(self, words: list[str]) -> None:
        """Words of letters only are one pre-token each: encode them in a row and cut by word number."""
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        owner = np.array(e.word_ids, np.int64)
        if not len(owner) or owner[-1] + 1 != len(words):
            return self._plain(words)
        ids = np.array(e.ids, "<u4").tobytes()
        ends = np.cumsum(np.bincount(owner)) * 4
        at = 0
        for w, end in zip(words, ends.tolist(), strict=True):
            self.young[w] = ids[at:end]
            at = end
        return None

    def learn(self, words: set[str]) -> None:
        if len(self.young) + len(words) > CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        cores, rest, tails = set(), [], []
        for w in words.difference(young):
            if (b := old.get(w)) is not None:
                young[w] = b
                continue
            core, tail = (w[:-1], w[-1]) if w[-1] in ".,;:!?|" else (w, "")
            low = core if "Σ" in core else core.lower()
            if not (core.isalpha() and low.isalpha()):
                rest.append(w)
                continue
            cores.add(low)
            if tail:
                cores.add(tail)
            if low != w:
                tails.append((w, low, tail))
        need = []
        for c in cores:
            if c not in young:
                if (b := old.get(c)) is not None:
                    young[c] = b
                else:
                    need.append(c)
        letters = [c for c in need if c.isalpha()]
        if letters:
            self._alphabetic(letters)
        if other := [c for c in need if not c.isalpha()] + rest:
            self._plain(other)
        for w, core, tail in tails:
            young[w] = young[core] + (young[tail] if tail else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [re.split(r"[^\S\x1c-\x1f]+", t.strip(" ")) if any(c in t for c in SEPARATORS) else t.split() for t in texts]
        split = [[w for w in ws if w] if ws and ("" in ws) else ws for ws in split]
        words: set[str] = set()
        for ws in split:
            words.update(ws)
        self.learn(words)
        get = self.young.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


class TextIds:
    """Ids of texts that are encoded as a whole, by any tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def by_words(path: str) -> bool:
    """Whether a tokenizer file is of the kind that WordIds reads: blanks part words and are dropped, and no added token holds one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    plain = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["truncation"] is None and spec["padding"] is None
    return added and plain and spec["model"]["type"] == "BPE"


_IDS: dict[str, WordIds | TextIds] = {}


def ids_of(path: str) -> WordIds | TextIds:
    if path not in _IDS:
        _IDS[path] = (WordIds if by_words(path) else TextIds)(path)
    return _IDS[path]


class SumOfSquares:
    """Open windows by fill level. ``place`` returns the window a piece of ``size`` went to.

    Pieces are ``[doc_id, start, length, ids, doc_tokens]``.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.gain = np.full(window + 1, 1 << 40, np.int64)  # of taking a window from a level; none there: never
        self.gain[0] = 0
        self.cost = np.ones(window + 1, np.int64)  # of adding one to a level
        self.cost[window] = 0
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def _add(self, level: int, n: int) -> None:
        if 0 < level < self.window:
            self.count[level] += n
            c = self.count[level]
            self.gain[level] = 1 - 2 * c if c else 1 << 40
            self.cost[level] = 2 * c + 1

    def place(self, piece: list) -> list | None:
        """Put a piece of less than a window where it costs least, the fuller level on a tie; a window that is full now."""
        size, w = piece[2], self.window
        total = self.gain[: w - size + 1] + self.cost[size:]
        level = len(total) - 1 - int(np.argmin(total[::-1]))
        filled = self.open[level].pop() if level else []
        filled.append(piece)
        self._add(level, -1)
        self._add(level + size, 1)
        self.n_open += (not level) - (level + size == w)
        if level + size == w:
            return filled
        self.open.setdefault(level + size, []).append(filled)
        return None

    def finish(self) -> Iterator[list]:
        """Merge the open windows by cutting pieces, and cut what is left at powers of two."""
        left = [x for level in sorted(self.open, reverse=True) for x in self.open[level]]
        self.open, self.n_open = {}, 0
        self.count[:], self.gain[1:], self.cost[:-1] = 0, 1 << 40, 1
        i, j = 0, len(left) - 1
        while i < j:
            gap = self.window - sum(p[2] for p in left[i])
            while gap and i < j:
                gap -= self._move(left[j], left[i], gap)
                if not left[j]:
                    j -= 1
            if not gap:
                yield left[i]
                i += 1
        if i == j:
            total = sum(p[2] for p in left[i])
            while total:
                part: list[list] = []
                want = self.window if total >= self.window else 1 << (total.bit_length() - 1)
                total -= want
                while want:
                    want -= self._move(left[i], part, want)
                yield part

    @staticmethod
    def _move(source: list, target: list, most: int) -> int:
        """Move the source's last piece, or the first ``most`` ids of it, to the target."""
        piece = source[-1]
        if piece[2] <= most:
            target.append(source.pop())
            return piece[2]
        doc, start, length, ids, tokens = piece
        target.append([doc, start, most, ids[: 4 * most], tokens])
        source[-1] = [doc, start + most, length - most, ids[4 * most :], tokens]
        return most


def pack_rows(rows: Iterator[tuple[int, bytes]], first_sequence: int, window: int = WINDOW) -> Iterator[tuple]:
    """Rows of SCHEMA for ``(doc_id, ids as bytes)`` in order."""
    packer, sequence = SumOfSquares(window), first_sequence

    def laid(pieces: list[list]) -> Iterator[tuple]:
        nonlocal sequence
        offset = 0
        for doc, start, length, ids, tokens in pieces:
            yield doc, start, length, zlib.crc32(ids), tokens, sequence, offset
            offset += length
        sequence += 1

    for doc, ids in rows:
        tokens = len(ids) // 4
        full = tokens - tokens % window
        for start in range(0, full, window):
            yield from laid([[doc, start, window, ids[4 * start : 4 * (start + window)], tokens]])
        if full < tokens and (done := packer.place([doc, full, tokens - full, ids[4 * full :], tokens])):
            yield from laid(done)
        if packer.n_open > OPEN:
            for pieces in packer.finish():
                yield from laid(pieces)
    for pieces in packer.finish():
        yield from laid(pieces)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``window`` ids; one row per piece.

    ``window`` is a power of two. Each input partition is packed in the order of its rows without any
    shuffle, with memory for at most 8192 open windows, and numbers its sequences from its own range, so
    a task that is run again gives the same rows. A tokenizer that is not of the default one's kind encodes whole texts. A null or empty text is the end id alone; a null
    doc_id stays null; repeated rows are packed each; other columns are not read; an empty table
    gives no rows.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = ids_of(path)
        schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for k in range(0, len(ids), 250):
                    for d, b in zip(ids[k : k + 250], words.encode(batch.column(1).slice(k, 250).to_pylist()), strict=True):
                        yield d, b + end

        got: list[tuple] = []
        for row in pack_rows(rows(), TaskContext.get().partitionId() << 36, window):
            got.append(row)
            if len(got) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], schema=schema)
                got = []
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, SCHEMA)


def in_file_order(docs: DataFrame) -> DataFrame:
    """Rows of a table of Parquet files in ranges by name of file and place in it; other rows as they are.

    Spark deals files to tasks by size, so the order in which a sorted table was written is lost
    on reading.
    """
    fresh = {"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")}
    try:
        placed = docs.withColumns(fresh)
    except AnalysisException:
        return docs
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, *fresh).sortWithinPartitions(*fresh).drop(*fresh)
