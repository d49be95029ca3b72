"""WARC records in ZIP packages, read by ranges without extraction.

Each task writes one package in the shared folder: a stored member with the records, each a gzip member of its own, and a
stored member with an index line per record.  A reader parses the end record, the ZIP64 one where there is one, and the
central directory, finds the members' bytes through their local headers, and reads records by the index's offsets.
Packages have names of their own for each attempt of a task; the manifest, a table, names only those of tasks that
ended well, so a lost executor leaves unread files at worst.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .shared import partitions, shared_dir, written

RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.jsonl"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records bigint, bytes bigint"
_PAGE = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def _end(read, size: int) -> tuple[int, int, int]:
    """Number of entries, size and place of the central directory."""
    at = max(0, size - 65557)
    tail = read(at, size - at)
    i = tail.rfind(b"PK\x05\x06")
    if i < 0:
        raise ValueError("no end of central directory")
    entries, length, place = struct.unpack_from("<HII", tail, i + 10)
    if 0xFFFF == entries or 0xFFFFFFFF in (length, place):
        sign, _, end64 = struct.unpack_from("<IIQ", read(at + i - 20, 20))
        if sign != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        entries, length, place = struct.unpack_from("<QQQ", read(end64, 56), 32)
    return entries, length, place


def members(read, size: int) -> dict[str, Member]:
    """The entries of a package's central directory; ``read(at, n)`` gives bytes of it, ``size`` is its length."""
    entries, length, place = _end(read, size)
    raw, at, out = read(place, length), 0, {}
    for _ in range(entries):
        sign, _, _, flags, method, _, _, _, packed, full, n_name, n_extra, n_note, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if sign != 0x02014B50:
            raise ValueError("damaged central directory")
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:  # ZIP64: only the fields that do not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            i += 4 + n
        out[name] = Member(name, method, packed, header)
        at += 46 + n_name + n_extra + n_note
    return out


def data_place(read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    sign, n_name, n_extra = struct.unpack("<I22xHH", read(member.header, 30))
    if sign != 0x04034B50:
        raise ValueError("damaged local header")
    return member.header + 30 + n_name + n_extra


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record; a revisit keeps the HTTP head, whose Content-Length is that of the payload left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """The columns of a page from a record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(named["Content-Length"])].partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
    page = named["WARC-Record-ID"][10:-1]
    number = lambda x: None if x in (None, "None") else int(x)
    revisit = named["WARC-Type"] == "revisit"
    if revisit:
        digest, payload = named["WARC-Payload-Digest"].removeprefix("sha256:"), None
    else:
        digest = hashlib.sha256(payload).hexdigest()
        if len(payload) != length or named["WARC-Payload-Digest"] != f"sha256:{digest}":
            raise ValueError(f"damaged record {page}")
    return number(page), named.get("WARC-Target-URI"), named["WARC-Type"], number(named.get("WARC-Refers-To", "<urn:page:None>")[10:-1]), digest, length, payload


def _zip(text: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(text) + z.flush()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Writes a record per row and returns the manifest (path, records, bytes) of the packages.

    Of rows with equal payloads (``html`` in UTF-8, null as empty) of at least ``min_bytes`` bytes, that with the smallest id
    is a response and the others revisits of it; rows that repeat that id are responses too.  Shorter payloads and, where
    all ids are null, all rows are responses.  A null id sorts after all others.  Other columns are not read.  An empty table
    gives an empty manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    )
    folder = shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, index, at = f"pages-{uuid.uuid4().hex}.wacz", [], 0
        out = package = member = None
        for b in pieces(batches):
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if member is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}")
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    member = package.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
                revisit = refers is not None and page_id != refers
                packed = _zip(record(page_id, url, payload, digest, refers, revisit))
                member.write(packed)
                index.append(json.dumps([page_id, at, len(packed)]))
                at += len(packed)
        if member is None:
            return
        member.close()
        package.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
        package.close()
        out.close()
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(index), "bytes": at}])

    marked = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.col("first"))
    return written(marked.mapInArrow(run, _MANIFEST))


def _reader(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    file = fs.open_input_file(at)

    def read(place: int, n: int) -> bytes:
        file.seek(place)
        return file.read(n)

    return read, file.size()


def ranges(path: str, ids: set[int] | None = None, block: int = 4 << 20) -> Iterator[bytes]:
    """The records of a package, or only those of some ids, unpacked; neighbours are read in one range of ``block`` bytes."""
    read, size = _reader(path)
    found = members(read, size)
    index = read(data_place(read, found[INDEX]), found[INDEX].size).decode()
    base, held, start = data_place(read, found[RECORDS]), b"", 0
    for line in index.split("\n") if index else []:
        page_id, at, n = json.loads(line)
        if ids is not None and page_id not in ids:
            continue
        if at < start or at + n > start + len(held):
            start, held = at, read(base + at, n if ids is not None else max(n, min(block, found[RECORDS].size - at)))
        yield zlib.decompress(held[at - start : at - start + n], 31)


def read_archives(manifest: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """The pages of all packages in a manifest, or those of ``ids``; a revisit's payload is null, the rest is the full payload's."""
    wanted = None if ids is None else set(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _PAGE.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for raw in ranges(path, wanted):
                    rows.append(parse_record(raw))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return manifest.select("path").repartition(partitions(manifest.sparkSession)).mapInArrow(run, _PAGE)
