"""WARC archives: writing, normalising whole-file gzip streams, and reading by a sidecar offset index.

``write_archives`` writes pages as WARC 1.1 records, each file one whole gzip stream, the payload of equal pages once and
revisit records for the rest. ``normalise`` inflates such a stream once, front to back, rewrites every record as a gzip
member of its own and writes a sidecar index (a line a record: id, offset, length). ``read_archives`` deals the index out
and reads members by offset, many tasks a file.

Files are written under new names by every attempt; only those that a finished task returns are read, so a lost executor
costs a retry and leaves an unread file. Paths are URIs that pyarrow's file systems open.

Edge cases: a null payload is empty; a page with a null page_id is a revisit if another page has its payload, else a
response, and its page_id is null again when read; rows that repeat the smallest page_id of a payload are all responses;
a null url is written as urn:none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.session import durable, new_path, ship

#: Fixed value: the profile of records that repeat a payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
ARCHIVE_BYTES = 32_000_000


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record without compression. A revisit keeps the HTTP head, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "none" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:none'}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + END + block + END


def headers_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of an inflated stream that comes in pieces."""
    held = bytearray()
    want, head = 0, {}
    for piece in pieces:
        held += piece
        while True:
            if not want:
                at = held.find(END)
                if at < 0:
                    break
                head = headers_of(bytes(held[:at]))
                want = at + 4 + int(head["content-length"]) + 4
            if len(held) < want:
                break
            yield head, bytes(held[:want])
            del held[:want]
            want = 0
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or several, read once in pieces."""
    engine = zlib.decompressobj(31)
    while piece := stream.read(1 << 20):
        while piece:
            yield engine.decompress(piece)
            piece = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
            else:
                break


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, engine, name, size, count = None, None, "", 0, 0
        done: list[tuple[str, int]] = []

        def close():
            out.write(engine.flush())
            out.close()
            done.append((f"{folder}/{name}", count))

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers = (batch.column(c)[i].as_py() for c in range(4))
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = record(page, url, payload, refers)
                out.write(engine.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return run


def _normaliser(folder: str):
    names = ["path", "index", "records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, at = _open(path)
                name, offset, lines = uuid.uuid4().hex, 0, []
                with source.open_input_stream(at, compression=None) as stream, fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out:
                    for head, raw in split_records(inflated(stream)):
                        engine = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = engine.compress(raw) + engine.flush()
                        out.write(member)
                        lines.append(f"{head['warc-record-id']}\t{offset}\t{len(member)}\n")
                        offset += len(member)
                with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as out:
                    out.write("".join(lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.warc.gz"]), pa.array([f"{folder}/{name}.idx"]), pa.array([len(lines)], pa.int64())], names=names)

    return run


def _ranges(per_range: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _open(index)
                with fs.open_input_stream(at, compression=None) as f:
                    places = [tuple(map(int, line.split("\t")[1:])) for line in f.read().decode().splitlines()]
                for i in range(0, len(places), per_range):
                    part = places[i : i + per_range]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[p[0] for p in part]], pa.list_(pa.int64())), pa.array([[p[1] for p in part]], pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])

    return run


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def parse(raw: bytes) -> tuple:
    """The fields of one record; a response's payload is checked against its digest."""
    cut = raw.index(END)
    head = headers_of(raw[:cut])
    block = raw[cut + 4 : cut + 4 + int(head["content-length"])]
    http = block.index(END)
    payload = block[http + 4 :]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    number = lambda k: int(head[k].removeprefix("<urn:page:").rstrip(">")) if k in head and "none" not in head[k] else None
    size = int(headers_of(block[:http])["content-length"])
    if head["warc-type"] == "response" and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its record")
    return (number("warc-record-id"), size, digest, head["warc-type"], number("warc-refers-to"), head["warc-target-uri"], payload if head["warc-type"] == "response" else None)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, offsets, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            fs, at = _open(path)
            rows = []
            with fs.open_input_file(at) as f:
                for offset, length in zip(offsets, lengths, strict=True):
                    rows.append(parse(zlib.decompress(f.read_at(length, offset), 31)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(path, records) of the archives written to ``folder``, each one whole gzip stream. Payloads below ``least_bytes``
    are always written in full."""
    ship(pages.sparkSession)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    small = durable(own.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")), "warc-digests")
    first = small.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"))
    known = own.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    refers = small.join(first, ["digest", "size"]).where("page_id is null or page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    rows = known.join(refers.withColumnsRenamed({"page_id": "of_page", "digest": "of_digest"}).hint("merge"), F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")
    return durable(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(_writer(folder), "path string, records long"), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, index, records): every archive of ``path`` rewritten with a member a record, and its sidecar index."""
    ship(archives.sparkSession)
    spread = archives.select("path").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return durable(spread.mapInArrow(_normaliser(folder), "path string, index string, records long"), "warc-normal")


def read_archives(archives: DataFrame, per_range: int = 256) -> DataFrame:
    """The records of normalised archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    ship(archives.sparkSession)
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = archives.select("path", "index").repartition(n, "path").mapInArrow(_ranges(per_range), "path string, offsets array<long>, lengths array<long>")
    return ranges.repartition(n, "path", "offsets").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op6_warc_normaliser(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    whole = write_archives(pages, new_path(spark, "warc-whole"))
    found = read_archives(normalise(whole, new_path(spark, "warc-members")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
