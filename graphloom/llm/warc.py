"""WARC archives in ZIP packages, read through their directories by range.

A package is a ZIP file whose members are all stored, so a record lies at a
known range of the package: ``archive/data.warc.gz`` has each WARC record as a
gzip member of its own and ``indexes/index.cdxj`` names the range of each. The
reader finds the end record (ZIP64 where there is one), parses the central
directory, locates the members, and reads records by range; nothing is unpacked.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, narrow, open_fs, partition_id, scratch

#: Payloads below this many bytes are always written as responses.
REVISIT_BYTES = 1000
#: Compressed bytes after which a writer starts another package.
PACKAGE_BYTES = 32_000_000
#: Most bytes that a reader asks for at once, if no single record is longer.
READ_BYTES = 4_000_000

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD_ID = "<urn:graphloom:page:{}>"
_PAGE = re.compile(r"<urn:graphloom:page:(-?\d*)>")
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


# ---------------------------------------------------------------- ZIP packages


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A package of stored members; with ZIP64 records where needed or asked for."""
    body, directory = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(body)
        wide = zip64 or len(data) >= _MAX32 or at >= _MAX32
        size = _MAX32 if wide else len(data)
        local = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        body += struct.pack("<4s5H3L2H", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(local)) + raw + local + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        directory += struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if wide else at) + raw + extra
    at, n = len(body), len(members)
    end = b""
    if zip64 or at >= _MAX32 or n >= _MAX16 or len(directory) >= _MAX32:
        end = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(directory), at)
        end += struct.pack("<4sLQL", b"PK\6\7", 0, at + len(directory), 1)
        end += struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0)
    else:
        end = struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, len(directory), at, 0)
    return bytes(body + directory) + end


class Package:
    """Members of a ZIP file that is open for random access."""

    def __init__(self, f):
        self.f = f
        total = f.size()
        tail_at = max(0, total - 22 - _MAX16 - 20)
        tail = self.read(tail_at, total - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\5\6", 0, end + 3)
        if end < 0:
            raise ValueError("no end record: not a ZIP file")
        n, size, at = struct.unpack_from("<HLL", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
            where = struct.unpack_from("<Q", tail, end - 20 + 8)[0]
            record = self.read(where, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("the ZIP64 end record is not where its locator points")
            n, size, at = struct.unpack_from("<QQQ", record, 32)
        self.members = self._directory(self.read(at, size), n)

    def read(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        out = self.f.read(size)
        if len(out) != size:
            raise EOFError(f"the package ends {size - len(out)} bytes early")
        return out

    @staticmethod
    def _directory(raw: bytes, n: int) -> dict[str, tuple[int, int, int]]:
        """Name to (method, size, place of the local header)."""
        out, p = {}, 0
        for _ in range(n):
            if raw[p : p + 4] != b"PK\1\2":
                raise ValueError("damaged central directory")
            method = struct.unpack_from("<H", raw, p + 10)[0]
            packed, size, name, extra, comment = struct.unpack_from("<LLHHH", raw, p + 20)
            at = struct.unpack_from("<L", raw, p + 42)[0]
            q, stop = p + 46 + name, p + 46 + name + extra
            while q + 4 <= stop:
                kind, length = struct.unpack_from("<HH", raw, q)
                if kind == 1:  # only fields that are full below stand here, in this order
                    v = list(struct.unpack_from(f"<{length // 8}Q", raw, q + 4))
                    size = v.pop(0) if size == _MAX32 else size
                    packed = v.pop(0) if packed == _MAX32 else packed
                    at = v.pop(0) if at == _MAX32 else at
                q += 4 + length
            out[raw[p + 46 : p + 46 + name].decode()] = (method, size, at)
            p = stop + comment
        return out

    def place(self, name: str) -> tuple[int, int]:
        """(first byte, bytes) of a stored member."""
        method, size, at = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; its records can't be read by range")
        head = self.read(at, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        return at + 30 + sum(struct.unpack_from("<HH", head, 26)), size


# ---------------------------------------------------------------- WARC records


def _line(name: str, value: str) -> str:
    return f"{name}: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value) + "\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record with the HTTP head alone."""
    own = "" if page_id is None else page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    text = "WARC/1.1\r\n" + _line("WARC-Type", "response" if refers_to is None else "revisit")
    text += _line("WARC-Record-ID", RECORD_ID.format(own)) + _line("WARC-Date", date)
    if url is not None:
        text += _line("WARC-Target-URI", url)
    text += _line("WARC-Payload-Digest", f"sha1:{digest}")
    if refers_to is not None:
        text += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        text += _line("WARC-Refers-To", RECORD_ID.format(refers_to))
    text += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", str(len(block)))
    return text.encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """The fields of a record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
    if f["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
    page = lambda x: int(m[1]) if (m := _PAGE.fullmatch(x)) and m[1] else None
    return {
        "page_id": page(f["warc-record-id"]),
        "url": f.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": f["warc-type"],
        "refers_to": page(f["warc-refers-to"]) if "warc-refers-to" in f else None,
        "payload": payload if f["warc-type"] == "response" else None,
    }


# ---------------------------------------------------------------- jobs


def _writer(folder: str, date: str, package_bytes: int, zip64: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def close() -> pa.RecordBatch:
            path = f"{folder}/{partition_id():06d}-{uuid.uuid4().hex}.wacz"
            fs, at = open_fs(path)
            fs.create_dir(folder_of(at), recursive=True)
            with fs.open_output_stream(at) as f:
                f.write(zip_bytes([(DATA, bytes(data)), (INDEX, "".join(index).encode())], zip64))
            out = pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))
            data.clear()
            index.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                raw = gzip.compress(record(row["p"], row["url"], row["payload"], row["digest"], row["refers"], date), 5, mtime=0)
                index.append(json.dumps({"page": row["p"], "url": row["url"], "offset": len(data), "length": len(raw)}) + "\n")
                data += raw
                if len(data) >= package_bytes:
                    yield close()
        if index:
            yield close()

    return run


def folder_of(path: str) -> str:
    return path.rpartition("/")[0]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes a record per page into packages; returns their manifest (path, records).

    Of equal payloads (by SHA-256) of ``revisit_bytes`` or more, the rows with
    the largest id are responses and the others revisit it; a page without id
    is never the one referred to if another has one. The groups are counted
    with map-side combine and only those with two rows or more are joined
    back, so a hot payload meets in no single task. A null page is an empty
    payload; smaller pages take no part in the join. A payload of any length
    is one record; an empty table gives an empty manifest. Each attempt writes
    files of its own; the manifest names those that counted. ``folder`` must be shared by all machines.
    """
    d = narrow(pages, id_col, url_col, html_col)
    d = d.select(F.col(id_col).cast("long").alias("p"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    d = d.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    d = d.withColumn("k", F.when(large, F.sha2("payload", 256)))
    copies = d.filter("k is not null").groupBy("k").agg(F.max("p").alias("first"), F.count("*").alias("n")).filter("n > 1").select("k", "first")
    rows = d.filter("k is not null").join(copies, "k", "left").select("p", "url", "payload", "digest", F.when(~F.col("p").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))
    small = d.filter("k is null").select("p", "url", "payload", "digest", F.lit(None).cast("long").alias("refers"))  # no key, so no join
    rows = rows.union(small)
    m = rows.mapInArrow(_writer(folder, date, package_bytes, zip64), "path string, records long")
    return materialise(m, "warc-manifest")


def _ranges(lines: list[dict], most: int) -> Iterator[list[dict]]:
    """Adjacent records, together as long as they stay within ``most`` bytes."""
    held: list[dict] = []
    for x in lines:
        if held and (x["offset"] != held[-1]["offset"] + held[-1]["length"] or x["offset"] + x["length"] - held[0]["offset"] > most):
            yield held
            held = []
        held.append(x)
    if held:
        yield held


_FIELDS = [("page_id", "long"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"), ("payload", "binary")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def package_records(f, most: int = READ_BYTES) -> Iterator[list[dict]]:
    """Parsed records of an open package, range by range."""
    package = Package(f)
    data_at, _ = package.place(DATA)
    lines = [json.loads(x) for x in package.read(*package.place(INDEX)).splitlines()]
    for part in _ranges(lines, most):
        raw = package.read(data_at + part[0]["offset"], part[-1]["offset"] + part[-1]["length"] - part[0]["offset"])
        yield [parse(gzip.decompress(raw[(a := x["offset"] - part[0]["offset"]) : a + x["length"]])) for x in part]


def _reader(fields: list[tuple[str, str]]):
    schema = pa.schema([(n, _ARROW[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    for rows in package_records(f):
                        yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names} for r in rows], schema=schema)

    return run


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """A row per record of the packages of a manifest, a task each package.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to and,
    if asked for, payload (null for revisits).
    """
    fields = _FIELDS if payload else _FIELDS[:-1]
    paths = manifest.select("path").repartition(max(1, manifest.count()))
    return paths.mapInArrow(_reader(fields), ", ".join(f"{n} {t}" for n, t in fields))


def round_trip(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    return read_archives(write_archives(pages, folder or scratch(pages.sparkSession, "warc"), **how))


SQL = """
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM (SELECT page_id, h, CASE WHEN octet_length(encode(h)) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS keep
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))"""
