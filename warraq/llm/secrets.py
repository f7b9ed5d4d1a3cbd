"""Secret scans: three base patterns, and structures confirmed by decoding.

Every run of base64 or hex characters that is long enough is a candidate, also one that is wrapped
over lines. It is reported only when its bytes parse: DER private keys whose nested
lengths add up, OpenSSH private keys whose length-prefixed fields add up, PEM blocks around either,
signed tokens whose header and payload are JSON objects with an algorithm, and text in which one of
these is found in turn.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.common import ship, whole

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
BEGIN, END = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----"), "-----END %s-----"
#: Runs of base64 and hex characters. A hex run is a base64 run, too.
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: A run that goes on over lines of at least 40 characters, with line ends as they are or escaped.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}+(?:[ \t]*+\r?\n[ \t]*+|(?:\\r)?\\n))++[A-Za-z0-9+/_-]++={0,2}")
#: Three runs with dots between; the first begins where no run goes on.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{3,}+)\.([A-Za-z0-9_-]*+)")
#: Layers of encoding that are taken off.
DEPTH = 4
WORDS = ("password", "passwd", "secret", "token")
HEX_RUN = re.compile(r"[0-9A-Fa-f]+")


def decode64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the DER values that fill data exactly; None if the lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80:
                return None
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A private key in PKCS#1, SEC1, DSA, PKCS#8 or encrypted PKCS#8 form, each nested length in place."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(top[0][1])
    if not items or len(items) < 2:
        return False
    tags = [t for t, _ in items]
    if tags[0] == 0x02 and items[0][1] in (b"\0", b"\1"):
        if len(items) in (6, 9) and set(tags) == {0x02}:
            return len(items[1][1]) >= 16
        if tags[1] == 0x04:
            return len(items[1][1]) >= 16 and all(der_items(c) is not None for t, c in items[2:] if t & 0xA0 == 0xA0)
    if tags[0] == 0x02:
        items, tags = items[1:], tags[1:]
    if len(items) >= 2 and tags[0] == 0x30 and tags[1] == 0x04 and len(items[1][1]) >= 16:
        name = der_items(items[0][1])
        return bool(name) and name[0][0] == 0x06 and len(name[0][1]) >= 3
    return False


def is_openssh_key(data: bytes) -> bool:
    """openssh-key-v1: three strings, a count, that many public keys and the private part, to the last byte."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, left = len(magic), 3
    while left:
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        left -= 1
    if at + 4 > len(data):
        return False
    left, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
    if left < 2:
        return False
    while left:
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        left -= 1
    return at == len(data)


def is_token(head: str, payload: str, signature: str) -> bool:
    """A signed token: header with an algorithm, payload object, and a signature unless the algorithm is none."""
    data = decode64(head)
    if not data or data.lstrip()[:1] != b"{":
        return False
    try:
        h, p = json.loads(data), json.loads(decode64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    if not (isinstance(h, dict) and isinstance(p, dict) and isinstance(h.get("alg"), str)):
        return False
    return h["alg"].lower() == "none" or len(decode64(signature) or b"") >= 16


def token_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """Signed tokens. A run may be the first, second or third part, and a name may stand before the first."""
    at = 0
    while m := TOKEN.search(text, at):
        names = (x.start() for x in re.finditer(r"(?<=[_-])(?=e[yw])", m[1][:64]))
        found = next((s for s in (0, *names) if is_token(m[1][s:], m[2], m[3])), None)
        if found is None:
            at = m.end(1)
        else:
            yield m.start() + found, 6, m.end()
            at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, leftmost non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS) or ("api" in low and "key" in low):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def kind_of(data: bytes, depth: int) -> int | None:
    """The kind of a decoded candidate, or of what it holds in turn as text."""
    if data[:1] == b"0" and is_der_key(data):
        return 4
    if is_openssh_key(data):
        return 5
    if depth:
        # Text is told by its first bytes, so that binary data is not decoded as a whole.
        try:
            data[:64].decode("ascii")
            text = data.decode("ascii")
        except UnicodeDecodeError:
            return None
        inner = confirmed_spans(text, depth - 1)
        return min(inner)[1] if inner else None
    return None


def readings(run: str) -> Iterator[bytes]:
    """The bytes that a run may stand for."""
    if len(run) % 2 == 0 and HEX_RUN.fullmatch(run):
        yield bytes.fromhex(run)
    if data := decode64(run):
        yield data


def starts(run: str) -> Iterator[int]:
    """Places in a run at which base64 may begin: its own, and after signs that paths and names put before a value."""
    yield 0
    for m in re.finditer(r"(?<=[/_-])(?=M[A-Za-z0-9+/])", run[:64]):
        yield m.start()


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and characters of base64 and hex runs, over lines first."""
    for m in WRAPPED.finditer(text) if "\n" in text or "\\n" in text else ():
        yield m.start(), m.end(), re.sub(r"\s|\\[rn]", "", m[0])
    for m in RUN.finditer(text):
        yield m.start(), m.end(), m[0]


def pem_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """PEM blocks from each opening line to the next closing one of its label, whose body holds a key."""
    end = 0
    for m in BEGIN.finditer(text):
        if m.start() < end:
            continue
        close = END % m[1]
        other = text.find("-----BEGIN ", m.end())
        stop = text.find(close, m.end(), other if other >= 0 else len(text))
        if stop < 0:
            continue
        body = re.sub(r"\\[nr]|^[A-Za-z0-9-]+: [^\n]*$", "", text[m.end() : stop], flags=re.M)
        data = decode64(re.sub(r"\s", "", body))
        if data and (is_der_key(data) or is_openssh_key(data)):
            end = stop + len(close)
            yield m.start(), 3, end


def confirmed_spans(text: str, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of candidates whose decoded structure holds; those within a reported one are left out."""
    out = list(pem_spans(text)) if "-----BEGIN " in text else []
    taken = sorted((a, b) for a, _, b in out)
    for a, b, run in candidates(text):
        # A PEM block or a wrapped run holds its lines.
        k = bisect_right(taken, (a, len(text) + 1)) - 1
        if k >= 0 and b <= taken[k][1]:
            continue
        found = next(((a + s, k) for s in (starts(run) if b - a == len(run) else (0,)) for data in readings(run[s:]) if (k := kind_of(data, depth)) is not None), None)
        if found:
            out.append((found[0], found[1], b))
            insort(taken, (a, b))
    if "." in text:
        out += token_spans(text)
    return out


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text: one row per row of docs.

    Returns ``doc_id``, counts by base kind, ``base_sha256`` and ``spans`` (``kind:start:end``, code
    points, end exclusive), and ``n_confirmed``. One pass without a shuffle. A null or empty text has
    no spans; a null id stays null; repeated rows are scanned each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for t in batch.column(1).to_pylist():
                base.append(base_spans(t))
                more.append(confirmed_spans(t))
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(3)]
            digests = pa.array([hashlib.sha256(named(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([named(b + m) for b, m in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, digests, spans, pa.array([len(m) for m in more], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    )
