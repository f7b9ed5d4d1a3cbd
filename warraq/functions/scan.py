"""One pass over each text, by Arrow batches and without a shuffle. Offsets are code points, as in Python's strings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from warraq.functions.text import KINDS, LETTERS, MARKS, STROKE
from warraq.functions.workers import importable

TOKEN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in KINDS.items()))
#: Fixed value: marks at the end of an address that are tokens of their own.
URL_ENDS = ".,،؛؟!"
DROPPED = re.compile(f"[{MARKS}{STROKE}]")
#: Rows that a task hands on at a time.
ROWS = 50_000


def tokens_of(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Consecutive tokens that make up the text: piece, start, stop and kind."""
    for m in TOKEN.finditer(text):
        kind, piece = m.lastgroup, m[0]
        if kind == "url" and piece[-1] in URL_ENDS:
            body = piece.rstrip(URL_ENDS)
            start, stop = m.start(), m.start() + len(body)
            yield body, start, stop, kind
            for mark in piece[len(body) :]:
                yield mark, stop, stop + 1, "punctuation"
                stop += 1
        else:
            yield piece, m.start(), m.end(), kind


def bare(word: str) -> str:
    """A word without marks and strokes."""
    return DROPPED.sub("", word)


def words_of(text: str) -> list[tuple[str, int, int, str]]:
    """Arabic and Latin words with their spans and lookup forms."""
    return [(piece, a, b, DROPPED.sub("", piece).lower()) for piece, a, b, kind in tokens_of(text) if kind in ("arabic", "latin")]


def rows_of(docs: DataFrame, found: Callable[[str], Iterator[tuple]], columns: str, *keep: str) -> DataFrame:
    """``doc_id``, the columns to keep, and those of each row that ``found`` gives for a text. A null text is an empty one."""
    spark = docs.sparkSession
    importable(spark)
    made: StructType = _parse_datatype_string(columns)
    kept = docs.select("doc_id", *keep)
    types = [to_arrow_type(f.dataType) for f in made.fields]
    names = [*kept.columns, *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            out: list[tuple] = []

            def part(b: pa.RecordBatch = b) -> pa.RecordBatch:
                index = pa.array(at, pa.int64())
                given = [b.column(k).take(index) for k in range(len(names) - len(types))]
                made_columns = zip(*out, strict=True)
                return pa.RecordBatch.from_arrays([*given, *(pa.array(c, t) for c, t in zip(made_columns, types, strict=True))], names=names)

            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                n = len(out)
                out.extend(found(text or ""))
                at += [i] * (len(out) - n)
                if len(out) >= ROWS:
                    yield part()
                    at, out = [], []
            if out:
                yield part()

    schema = StructType([*kept.schema.fields, *made.fields])
    return docs.select("doc_id", *keep, "text").mapInArrow(run, schema)
