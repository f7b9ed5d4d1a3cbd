"""Import of document files: plain text, Markdown, word-processor archives and PDF, in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions.workers import importable

#: Bytes of a file, and of what is inflated from it, that are taken at most; larger files are reported.
MOST_BYTES = 100_000_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHOWN = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\\.|[^\]])*)\]\s*TJ", re.S)
PLACED = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def from_docx(data: bytes) -> str:
    """A line per paragraph, with tabs and breaks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo("word/document.xml").file_size > MOST_BYTES:
            raise ValueError("too large")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    text = {W + "t": lambda e: e.text or "", W + "tab": lambda e: "\t", W + "br": lambda e: "\n"}
    return "\n".join("".join(text[e.tag](e) for e in p.iter() if e.tag in text) for p in root.iter(W + "p"))


def from_pdf(data: bytes) -> str:
    """The strings that uncompressed and Flate streams show, a line per stream."""
    lines, left = [], MOST_BYTES
    for body in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            d = zlib.decompressobj()
            body = d.decompress(body, left + 1)
        except zlib.error:
            pass
        left -= len(body)
        if left < 0:
            raise ValueError("too large")
        shown = [s for one, many in SHOWN.findall(body) for s in ([one] if one or not many else PLACED.findall(many))]
        plain = b"".join(re.sub(rb"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), s, flags=re.S) for s in shown)
        if plain:
            lines.append(plain.decode("latin-1"))
    return "\n".join(lines)


def from_markdown(text: str) -> str:
    """Headings, emphasis, code, links and list marks become their plain text."""
    for pattern, to in ((r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"`([^`\n]+)`", r"\1"), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1")):
        text = re.sub(pattern, to, text)
    return text


def imported(name: str, data: bytes | None) -> tuple[str | None, str | None]:
    """``(text, error)`` of a file by the ending of its name; one of the two is null."""
    data = data or b""
    if len(data) > MOST_BYTES:
        return None, "too large"
    kind = name.rpartition(".")[2].lower()
    try:
        if kind == "docx":
            return from_docx(data), None
        if kind == "pdf":
            return from_pdf(data), None
        text = data.decode("utf-8-sig")
        return (from_markdown(text) if kind in ("md", "markdown") else text), None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeDecodeError, ValueError) as e:
        return None, type(e).__name__ if not str(e) == "too large" else "too large"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, title, text, error`` of the files under a path; a file that cannot be read is a row with its error.

    Spark does not list empty files.
    """
    importable(spark)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in parts:
            yield pd.DataFrame([imported(n, c) for n, c in zip(names, contents, strict=True)], columns=["text", "error"])

    title = F.trim(F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), r'[\x00-\x1f<>:"|?*\\]', " "))
    content = F.when(F.col("length") <= MOST_BYTES, F.col("content")).otherwise(F.lit(None))
    rows = spark.read.format("binaryFile").load(path).select("path", title.alias("title"), "length", F.pandas_udf(run, "text string, error string")("path", content).alias("r"))
    big = F.col("length") > MOST_BYTES
    return rows.select("path", "title", F.when(~big, F.col("r.text")).alias("text"), F.when(big, "too large").otherwise(F.col("r.error")).alias("error"))
