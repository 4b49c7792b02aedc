"""WARC archives: a writer with revisit records and a sequential, verifying reader.

Every record is a gzip member of its own. The reader inflates a member step by step, frames
the record by its Content-Length, and checks block and payload digests as it goes. Archives
are files in a folder that all executors reach; a manifest table lists the complete ones,
so files that lost or repeated tasks leave behind are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmotif.runtime import pick, scratch

BLOCK = 1 << 18
ARCHIVE_BYTES = 256 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: object, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, first: tuple | None, date: str) -> bytes:
    """One WARC record; ``first`` is (page, url) of the response that a revisit refers to."""
    digest = base32_sha1(payload)
    target = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, url or '', digest)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        lines.append(f"Page-ID: {quote(str(page), safe='')}")
    if first is not None:
        lines += [
            f"WARC-Profile: {REVISIT}",
            f"WARC-Refers-To: {record_id(first[0], first[1] or '', digest)}",
            f"WARC-Refers-To-Target-URI: {quote(first[1] or '', safe="!#$%&'()*+,/:;=?@[]~")}",
        ]
        if first[0] is not None:
            lines.append(f"Refers-To-Page-ID: {quote(str(first[0]), safe='')}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, limit: int) -> Iterator[pa.RecordBatch]:
    store, root = _store(folder)
    out, path, size, count = None, "", 0, 0

    def done() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    for batch in batches:
        for i in range(batch.num_rows):
            page, url, html, revisit, first_page, first_url = (batch.column(c)[i].as_py() for c in ("page", "url", "payload", "revisit", "first_page", "first_url"))
            if out is None:
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                path, size, count = f"{folder}/{name}", 0, 0
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = record(page, url, html or b"", (first_page, first_url) if revisit else None, date)
            member = packer.compress(raw) + packer.flush()
            out.write(member)
            size, count = size + len(member), count + 1
            if size >= limit:
                yield done()
                out = None
    if out is not None:
        yield done()


def write_warc(
    pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write one record per row and return the manifest (path, records, bytes).

    Of equal payloads of at least ``min_revisit_bytes`` the row with the smallest (page_id, url) is the
    response and the others are revisits of it. A null page counts as an empty payload, a null page_id comes
    last, and rows repeated in id, url and payload are one visit, all of them responses if it is the first.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    rows = pick(pages, page=id_col, url=url_col, html=html_col).select(
        "page", "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")
    )
    keyed = rows.withColumn("sha", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    order = F.struct(F.col("page").isNull().alias("none"), F.col("page").alias("page"), F.col("url").alias("url"))
    first = keyed.where(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    joined = keyed.join(first, "sha", "left")
    same = F.col("page").eqNullSafe(F.col("first.page")) & F.col("url").eqNullSafe(F.col("first.url"))
    revisit = F.col("first").isNotNull() & ~same
    # A revisit carries no payload beyond its digest and length, but both come from the whole payload.
    ready = joined.select(
        "page", "url", "payload", revisit.alias("revisit"), F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url")
    )
    manifest = scratch(spark, "warc-manifest")
    ready.mapInArrow(lambda b: _write(b, folder, date, ARCHIVE_BYTES), "path string, records long, bytes long").write.parquet(manifest)
    return spark.read.schema("path string, records long, bytes long").parquet(manifest)


class RecordError(ValueError):
    """A record whose framing or digest is wrong."""


def _members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its inflated pieces; every piece stems from at most BLOCK compressed bytes."""
    rest = stream.read(BLOCK)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while True:
                piece = inflate.decompress(rest, 1 << 20)
                rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if piece:
                    yield piece
                if inflate.eof:
                    if not rest:
                        rest = stream.read(BLOCK)
                    return
                if not rest:
                    rest = stream.read(BLOCK)
                    if not rest:
                        raise RecordError("archive ends inside a member")

        yield pieces()


def _differs(stated: str | None, found: str) -> bool:
    """Whether a stated SHA-1 digest is another than the one found. Records may state none or use other algorithms."""
    algorithm, _, value = (stated or "").partition(":")
    return algorithm.lower() == "sha1" and value.upper() != found


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record in turn. Headers are lower-cased names; raises RecordError on bad data."""
    for pieces in _members(stream):
        buffer = bytearray()
        for piece in pieces:
            buffer += piece
            if (cut := buffer.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise RecordError("no end of headers")
        version, *lines = bytes(buffer[:cut]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise RecordError(f"not a record: {version[:20]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length, block = int(headers["content-length"]), buffer[cut + 4 :]
        digest = hashlib.sha1(block[:length])
        for piece in pieces:
            if len(block) < length:
                digest.update(piece[: length - len(block)])
            block += piece
        if len(block) != length + 4 or bytes(block[length:]) != b"\r\n\r\n":
            raise RecordError("content length and member disagree")
        if _differs(headers.get("warc-block-digest"), base64.b32encode(digest.digest()).decode()):
            raise RecordError("block digest differs")
        if not headers.get("content-type", "").lower().startswith("application/http"):
            yield headers, bytes(block[:length])  # warcinfo, metadata, resource and the like carry no HTTP head
            continue
        http, _, payload = bytes(block[:length]).partition(b"\r\n\r\n")
        for line in http.decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers["http-" + name.lower()] = value.strip()
        if headers.get("warc-type") == "response" and _differs(headers.get("warc-payload-digest"), base32_sha1(payload)):
            raise RecordError("payload digest differs")
        yield headers, payload


def _read(batches: Iterator[pa.RecordBatch], id_type: str) -> Iterator[pa.RecordBatch]:
    ids = pa.string() if id_type == "string" else pa.int64()
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [ids, pa.string(), pa.string(), ids, pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, at = _store(path)
            rows: list[tuple] = []
            size = 0
            with store.open_input_stream(at, compression=None) as stream:
                for h, payload in read_records(stream):
                    number = lambda k: int(h[k]) if re.fullmatch("-?[0-9]+", h.get(k, "")) else None
                    page = number if id_type != "string" else lambda k: unquote(h[k]) if k in h else None
                    # A revisit's digest and length are those of the full payload, which it does not hold.
                    stated = h.get("warc-payload-digest", "").partition(":")[2]
                    revisit = h.get("warc-type") == "revisit"
                    digest = stated or None if revisit else base32_sha1(payload)
                    size_of = number("http-content-length") if revisit else len(payload)
                    rows.append((page("page-id"), h.get("warc-target-uri"), h.get("warc-type"), page("refers-to-page-id"), digest, size_of, payload))
                    size += len(payload)
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_warc(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per record of the archives in ``manifest``: page_id, url, record_type, refers_to, payload_digest,
    payload_bytes and payload (empty for revisits, whose digest and length are those of the full payload). Archives
    of other writers may leave out digests, page ids and the HTTP length; what a record does not state is null.

    ``id_type`` is long or string, as the ids were when written; with long an id that is no integer is null. No archives,
    no rows."""
    if id_type not in ("long", "string"):
        raise ValueError("page ids are read as long or as string")
    paths = manifest.select("path")
    files = max(1, len(paths.inputFiles()))
    return paths.repartition(files).mapInArrow(
        lambda b: _read(b, id_type), f"page_id {id_type}, url string, record_type string, refers_to {id_type}, payload_digest string, payload_bytes long, payload binary"
    )
