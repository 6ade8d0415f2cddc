"""WARC records in ZIP packages: writing, and reading by byte ranges without extraction.

A package is a ZIP archive with stored members: ``archive/data.warc.gz`` (each
record a gzip member of its own) and ``indexes/index.cdxj`` (one line a record
with its place in the archive member).

The reader looks for the end-of-central-directory record from the end of the
file, follows the ZIP64 locator where there is one, parses the central directory
with its ZIP64 extra fields, and finds where a stored member's bytes lie in the
file.  The index and every record are then read by their byte range of the file.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the
smallest id is a response and the others revisit it.

Defined cases: a null payload is empty; a null id is written as ``null``, comes
after all others and is read back as null; rows that repeat an id and a payload
are responses each; line ends in urls become ``%0D`` and ``%0A``; an empty table
writes no package and returns no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolefit.llm.shared import shared_folder, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Raw bytes after which a package is closed: it bounds the writer's memory and the reader's task.
PACKAGE_BYTES = 32 << 20


# ---- writing -----------------------------------------------------------------
def _lines(*pairs: tuple[str, object]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode() + b"\r\n"


def record_id(page: object) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def warc_record(page: object, url: str | None, payload: bytes, date: str, revisits: object = None) -> bytes:
    """One record: a response with the payload, or a revisit with the HTTP header alone."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\n" + _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload)))
    block = http + (payload if revisits is None else b"")
    head = _lines(("WARC-Type", "response" if revisits is None else "revisit"), ("WARC-Record-ID", record_id(page)),
                  ("WARC-Date", date), ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")),
                  ("WARC-Profile", None if revisits is None else PROFILE),
                  ("WARC-Refers-To", None if revisits is None else record_id(revisits)),
                  ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response"),
                  ("Content-Length", len(block)))
    return b"WARC/1.1\r\n" + head + block + b"\r\n\r\n"


class _Package:
    """Records and index lines of one package."""

    def __init__(self) -> None:
        self.data, self.index, self.raw, self.count = io.BytesIO(), [], 0, 0

    def add(self, page: object, url: str | None, payload: bytes, date: str, revisits: object) -> None:
        record = warc_record(page, url, payload, date, revisits)
        at = self.data.tell()
        self.data.write(gzip.compress(record, 6, mtime=0))
        place = json.dumps({"id": page, "offset": at, "length": self.data.tell() - at})
        self.index.append(f"{json.dumps(url or '')} {place}\n".encode())
        self.raw += len(record)
        self.count += 1

    def packed(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, body in ((ARCHIVE, self.data.getvalue()), (INDEX, b"".join(self.index))):
                info = zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0))
                with z.open(info, "w", force_zip64=True) as f:
                    f.write(body)
        return out.getvalue()


def _writer(folder: str, date: str):
    def close(package: _Package) -> pa.RecordBatch:
        # a retried or repeated task writes names of its own; only the manifest tells which packages count
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.wacz"
        with files.open_output_stream(name) as f:
            f.write(package.packed())
        return pa.RecordBatch.from_pydict({"package": [name.rpartition("/")[2]], "records": pa.array([package.count], pa.int64())})

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = _Package()
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i) for i in range(4))):
                package.add(page.as_py(), url.as_py(), (html.as_py() or "").encode(), date, refers.as_py())
                if package.raw >= PACKAGE_BYTES:
                    yield close(package)
                    package = _Package()
        if package.count:
            yield close(package)
    return of


def write_packages(pages: DataFrame, folder: str, min_revisit: int = 0, date: str = "2024-01-01T00:00:00Z",
                   page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per row into packages in ``folder``; the manifest (package, records) names those that count."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("html"),
                        F.sha1(F.encode(payload, "UTF-8")).alias("digest"))
    long_enough = rows.filter(F.octet_length("html") >= min_revisit)
    first = long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    j = rows.join(first.select("digest", "first"), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return written(j.select("page_id", "url", "html", refers.alias("refers")).mapInArrow(_writer(folder, date), "package string, records long"),
                   "manifest")


# ---- the ZIP directory ---------------------------------------------------------
class Member(NamedTuple):
    name: str
    method: int
    start: int  # of its bytes in the file
    size: int


def _read(f, start: int, size: int) -> bytes:
    f.seek(start)
    raw = f.read(size)
    if len(raw) != size:
        raise ValueError(f"{size} bytes wanted at {start}, {len(raw)} there")
    return raw


def _directory_place(f, length: int) -> tuple[int, int]:
    """(start, size) of the central directory."""
    tail_at = max(0, length - 22 - 0xFFFF)  # the end record may be followed by a comment
    tail = _read(f, tail_at, length - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    entries, size, start = struct.unpack_from("<10xHII", tail, at)
    if entries == 0xFFFF or 0xFFFFFFFF in (size, start):
        locator_at = tail_at + at - 20
        if locator_at >= 0 and (locator := _read(f, locator_at, 20))[:4] == b"PK\x06\x07":
            end64 = _read(f, struct.unpack_from("<8xQ", locator)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory where the locator says")
            size, start = struct.unpack_from("<40xQQ", end64)
    return start, size


def members(f, length: int) -> dict[str, Member]:
    """The members of a ZIP file, by name, from its central directory."""
    start, size = _directory_place(f, length)
    raw, at, out = _read(f, start, size), 0, {}
    while at + 46 <= len(raw) and raw[at:at + 4] == b"PK\x01\x02":
        method, packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<10xH8xIIHHH", raw, at)
        header = struct.unpack_from("<42xI", raw, at)[0]
        name = raw[at + 46: at + 46 + n_name].decode()
        extra = raw[at + 46 + n_name: at + 46 + n_name + n_extra]
        whole, packed, header = _wide(extra, whole, packed, header)
        # the local header repeats the name and has an extra field of its own length
        local = _read(f, header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n_name_here, n_extra_here = struct.unpack_from("<26xHH", local)
        out[name] = Member(name, method, header + 30 + n_name_here + n_extra_here, packed)
        at += 46 + n_name + n_extra + n_comment
    return out


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values of 0xFFFFFFFF are replaced, in order, by the 64-bit ones of the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(wide) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + n
    return list(values)


# ---- reading --------------------------------------------------------------------
def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}


class Record(NamedTuple):
    kind: str
    refers: str | None
    digest: str
    payload_bytes: int
    payload: bytes | None


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http)["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "revisit":
        return Record("revisit", h["warc-refers-to"], digest, size, None)
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if found != digest or len(payload) != size:
        raise ValueError(f"payload of {h['warc-record-id']} does not match its header")
    return Record("response", None, digest, size, payload)


def package_records(f, length: int) -> Iterator[tuple[object, Record]]:
    """(id, record) of every index line; each record is read by its range of the file."""
    found = members(f, length)
    data, index = found[ARCHIVE], found[INDEX]
    if data.method or index.method:
        raise ValueError("members must be stored")
    for line in _read(f, index.start, index.size).splitlines():
        _, end = json.JSONDecoder().raw_decode(line.decode())
        place = json.loads(line.decode()[end:])
        if place["offset"] + place["length"] > data.size:
            raise ValueError("index line beyond the archive member")
        yield place["id"], parse_record(gzip.decompress(_read(f, data.start + place["offset"], place["length"])))


def _reader(folder: str, schema: pa.Schema, with_payload: bool):
    id_type = schema.field(0).type

    def named(urn: str | None) -> str | None:
        name = urn and urn.removeprefix("<urn:page:").removesuffix(">")
        return None if name in (None, "null") else name

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for package in batch.column(0).to_pylist():
                rows, held = [], 0
                with files.open_input_file(f"{root}/{package}") as f:
                    for page, r in package_records(f, f.size()):
                        rows.append((page, r.payload_bytes, r.digest, r.kind, named(r.refers), r.payload))
                        held += len(r.payload or b"") if with_payload else 0
                        if len(rows) == 5000 or held > (8 << 20):
                            yield _batch(rows, schema, id_type, with_payload)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, schema, id_type, with_payload)
    return of


def _batch(rows: list[tuple], schema: pa.Schema, id_type: pa.DataType, with_payload: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    refers = pa.array(cols[4], pa.string()).cast(id_type)
    made = [pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
            pa.array(cols[3], pa.string()), refers]
    return pa.RecordBatch.from_arrays(made + ([pa.array(cols[5], pa.binary())] if with_payload else []), schema=schema)


def read_packages(manifest: DataFrame, folder: str, id_type: T.DataType, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits) of every record."""
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = [T.StructField("page_id", id_type), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
              T.StructField("record_type", T.StringType()), T.StructField("refers_to", id_type)]
    schema = T.StructType(fields + ([T.StructField("payload", T.BinaryType())] if with_payload else []))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("package").repartition(n).mapInArrow(_reader(folder, to_arrow_schema(schema), with_payload), schema)


def round_trip(pages: DataFrame, min_revisit: int = 0, page_id: str = "page_id", with_payload: bool = False) -> DataFrame:
    """Write packages into a new shared folder and read them back."""
    folder = shared_folder(pages.sparkSession, "packages")
    manifest = write_packages(pages, folder, min_revisit, page_id=page_id)
    return read_packages(manifest, folder, pages.schema[page_id].dataType, with_payload)
