"""WARC archives: write, normalise from one gzip stream to a member per record, index, read back."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.common import discard, remove, scratch_path, ship, stored

#: Payloads of fewer bytes are written whole even when they repeat.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
CHUNK = 1 << 20


def _open(uri: str):
    """The file system and path of a URI of the shared folder, as Hadoop or Arrow spell its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def put(uri: str, write) -> None:
    """Write a file whose name is this attempt's own: a task that runs again writes another one, and the table of files names the one that counts."""
    system, path = _open(uri)
    with system.open_output_stream(path, compression=None) as f:
        write(f)


def record_id(page: int | None) -> str:
    return f"<urn:warraq:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(page)[1:-1]
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF * 2 + block + CRLF * 2


def header_fields(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v or k}


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, each by its own Content-Length, with one record in memory."""
    buffer = bytearray()
    done = False

    def more() -> bool:
        nonlocal done
        part = next(stream, None)
        done = part is None
        buffer.extend(part or b"")
        return not done

    while True:
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buffer) - 3)
            if not more():
                if buffer:
                    raise ValueError("archive ends inside a header")
                return
        size = end + 4 + int(header_fields(bytes(buffer[:end]))["content-length"]) + 4
        while len(buffer) < size:
            if not more():
                raise ValueError("archive ends inside a record")
        yield bytes(buffer[:size])
        del buffer[:size]


def inflated(f) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, read once from start to end, at most CHUNK at a time; any number of members."""
    z = zlib.decompressobj(31)
    while data := f.read(CHUNK >> 4):
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            if out := z.decompress(data, CHUNK):
                yield out
            data = z.unused_data if z.eof else z.unconsumed_tail
    if not z.eof:
        raise ValueError("archive ends inside a gzip member")


def _page(field: str) -> int | None:
    n = field.rpartition(":")[2].rstrip(">")
    return int(n) if n else None


def parsed(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and the payload. A response's are of the payload as it
    was read, and must be what its header says; a revisit has no payload, and those of the header."""
    head, _, block = data.partition(b"\r\n\r\n")
    h = header_fields(head)
    http, _, body = block[: int(h["content-length"])].partition(b"\r\n\r\n")
    digest, size = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex(), int(header_fields(http)["content-length"])
    if h["warc-type"] == "revisit":
        return _page(h["warc-record-id"]), size, digest, "revisit", _page(h["warc-refers-to"]), None
    found = hashlib.sha1(body).hexdigest()
    if (len(body), found) != (size, digest):
        raise ValueError(f"the payload of {h['warc-record-id']} has {len(body)} bytes and SHA-1 {found}, its header says {size} and {digest}")
    return _page(h["warc-record-id"]), len(body), found, "response", None, body


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages to monolithic ``.warc.gz`` files, one gzip stream per partition; a manifest ``(path, n_records)``.

    Equal payloads of 1,000 bytes or more are found by length and SHA-256: the largest page_id keeps the
    payload, others refer to it. Rows that repeat the same page_id and payload are all responses. A
    null html is an empty payload, a null url gets the record's own URN, and a null page_id
    is never referred to. Other columns are not read; an empty table writes no file. Payloads are shuffled by page_id, which
    spreads a payload that many pages share, and only revisits are joined to them.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumns({"same": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html")})
    large = rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "same", "size").distinct()
    last = large.groupBy("same", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = large.join(last, ["same", "size"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("page"), F.col("same").alias("of"), "refers_to")
    # Pages without an id are spread by payload, to meet their own revisits.
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("same") == F.col("of")), "left")
    marked = joined.select("page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("digest"), "refers_to", F.col("refers_to").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uri, n = f"{folder}/whole-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0

        def write(f) -> None:
            nonlocal n
            z = zlib.compressobj(3, zlib.DEFLATED, 31)
            for b in batches:
                for page, url, text, digest, to, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    f.write(z.compress(record(page, url, text.encode("utf-8", "surrogatepass"), digest, "revisit" if again else "response", to)))
                    n += 1
            f.write(z.flush())

        put(uri, write)
        yield pa.RecordBatch.from_pydict({"path": pa.array([uri] if n else [], pa.string()), "n_records": pa.array([n] if n else [], pa.int64())})

    return stored(marked.mapInArrow(run, "path string, n_records long"), "archives")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive of ``manifest(path)`` with one gzip member per record and a sidecar index.

    The whole-file stream is inflated once, with one record in memory. The index beside each file is a line of JSON per record:
    offset and length of its member, record id and type. Returns ``(path, index_path, n_records)``; a null path and
    an empty table give no rows, a repeated path a file for each row, and other columns are not read. An archive that ends early is an error.
    """
    spark = ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for uri in b.column(0).to_pylist():
                name = uri.rpartition("/")[2].removesuffix(".warc.gz")
                to = f"{folder}/members-{name}-{uuid.uuid4().hex}.warc.gz"
                lines: list[str] = []

                def write(f, uri=uri, lines=lines) -> None:
                    offset = 0
                    system, path = _open(uri)
                    with system.open_input_stream(path, compression=None) as source:
                        for data in records(inflated(source)):
                            z = zlib.compressobj(3, zlib.DEFLATED, 31)
                            member = z.compress(data) + z.flush()
                            f.write(member)
                            h = header_fields(data[: data.index(b"\r\n\r\n")])
                            lines.append(json.dumps({"offset": offset, "length": len(member), "id": h["warc-record-id"], "type": h["warc-type"]}))
                            offset += len(member)

                put(to, write)
                put(f"{to}.index", lambda f, lines=lines: f.write(("\n".join(lines) + "\n").encode()))
                out.append((to, f"{to}.index", len(lines)))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("path", "index_path", "n_records"), map(list, zip(*out, strict=True)), strict=True)))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(manifest.where("path is not null").select("path").repartition(n, "path").mapInArrow(run, "path string, index_path string, n_records long"), "normalised")


def read_members(normalised: DataFrame, payloads: bool = False) -> DataFrame:
    """Read every record of normalised archives by its index entry: one row per record.

    Payloads are hashed as they are read; one that is not what its header says is an error. A revisit has the digest of its
    header, and no payload. An empty table gives no rows; other columns are not read.
    """
    spark = ship(normalised.sparkSession)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
        for b in batches:
            for uri, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, path = _open(uri)
                with system.open_input_stream(_open(index)[1], compression=None) as f:
                    entries = f.read().decode().splitlines()
                with system.open_input_file(path) as f:
                    for k in range(0, len(entries), 500):
                        rows = []
                        for e in map(json.loads, entries[k : k + 500]):
                            f.seek(e["offset"])
                            rows.append(parsed(zlib.decompress(f.read(e["length"]), 31))[: len(names)])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return normalised.select("path", "index_path").repartition(n, "path").mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` as read, with each revisit's ``payload_bytes`` and ``payload_digest`` taken from the response that it refers to.

    A revisit without such a response, or with another digest than it, is an error. Other columns pass through, also the null payload of
    a revisit. Responses are reduced to one row for each page and digest before they are joined.
    """
    revisit = F.col("record_type") == "revisit"
    held = records.where(~revisit).groupBy(F.col("page_id").alias("held_page"), F.col("payload_digest").alias("held_digest")).agg(F.max("payload_bytes").alias("held_bytes"))
    joined = records.where(revisit).join(held, (F.col("refers_to") == F.col("held_page")) & (F.col("payload_digest") == F.col("held_digest")), "left")
    lost = F.raise_error(F.concat(F.lit("nothing to revisit for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    found = joined.withColumns({"payload_bytes": F.when(F.col("held_bytes").isNull(), lost.cast("long")).otherwise(F.col("held_bytes")), "payload_digest": F.col("held_digest")})
    return records.where(~revisit).unionByName(found.select(*records.columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages, normalise the archives, read each record back through the index and resolve revisits.

    Files go to the shared folder and are removed when the records have been read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    manifest = write_archives(pages, folder)
    members = normalise(manifest, folder)
    for row in manifest.select("path").toLocalIterator():
        remove(spark, row["path"])
    records = stored(read_members(members), "records")
    remove(spark, folder)
    discard(manifest, members)
    return resolve(records)
