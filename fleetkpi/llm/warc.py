"""Legacy archives to WARC.

ARC files name their version in a first record: version 1 has five fields in a record's header line,
version 2 ten, and in both the last one declares the length of what follows. `parse_arc` reads either
by that. `index` lists the records of archives with the digest of each payload; `convert` gives every
record a WARC identifier, timestamp, type and digests, and writes WARC/1.1. Of records with equal
payloads the one with the largest page is written whole, as response; the others are revisits that
refer to it. `read_warc` reads the result.

All archives are gzip files with one member a record. Tasks open them one by one; where a member
begins comes from the index, and no payload passes a shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, scratch_folder
from . import files

MIN_BYTES = 0
#: An archive is closed when it holds so many bytes.
FILE_BYTES, LEVEL = 8 << 20, 1
# Field names of the two versions of the format, and a profile of WARC/1.1.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "archive string, records bigint"
INDEX = "archive string, record bigint, offset bigint, page_id bigint, record_id string, payload_bytes bigint, payload_digest string"
RECORDS = "archive string, record bigint, page_id bigint, record_id string, record_type string, refers_to_id string, payload_bytes bigint, payload_digest string"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC has it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the members of a gzip file."""
    view, at = memoryview(content), 0
    while at < len(view):
        opened, out, begin, end = zlib.decompressobj(31), [], at, at
        while not opened.eof and end < len(view):
            part = view[end : end + 65_536]
            out.append(opened.decompress(part))
            end += len(part)
        if not opened.eof:
            raise ValueError("a gzip member is cut off")
        at = end - len(opened.unused_data)
        yield begin, b"".join(out)


# ---------------------------------------------------------------- ARC


def _safe(field: str | None) -> str:
    """A field of a header line: no white space or control characters, never empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", field or "") or "-"


def arc_start(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 Archive\n{' '.join(FIELDS[version])}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, ip: str, date: str, mime: str, status: int, body: bytes, name: str, offset: int) -> bytes:
    middle = f" {status} {digest(body)} - {offset} {name}" if version == 2 else ""
    return f"{_safe(url)} {ip} {date} {_safe(mime)}{middle} {len(body)}\n".encode() + body + b"\n"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    body: bytes


def arc_version(start: bytes) -> int:
    """Version of an archive, from the body of its first record."""
    header, _, rest = start.partition(b"\n")
    if not header.startswith(b"filedesc://"):
        raise ValueError("the first record does not describe an archive")
    declared = int(header.rsplit(b" ", 1)[1])
    version = int(rest[:declared].split(b" ", 1)[0])
    if version not in FIELDS:
        raise ValueError(f"no such version of the format: {version}")
    return version


def parse_arc(record: bytes, version: int) -> ArcRecord:
    """A record by the header line of its version and its declared length."""
    header, _, rest = record.partition(b"\n")
    values = header.decode().split(" ")
    if len(values) != len(FIELDS[version]):
        raise ValueError(f"a header line of version {version} has {len(FIELDS[version])} fields: {header[:200]!r}")
    fields = dict(zip(FIELDS[version], values, strict=True))
    declared = int(fields["Archive-length"])
    if len(rest) < declared or rest[declared:].strip(b"\n"):
        raise ValueError(f"declared length {declared}, found {len(rest)}: {header[:200]!r}")
    return ArcRecord(fields, rest[:declared])


def http_parts(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Header block, fields in lower case and payload of an HTTP response."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return head + mark, fields, payload


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Pages (page_id, url, html) as ARC files of both versions; the folder and the list of files.

    The version goes by the page_id, null ones to version 1. A null html is an empty payload.
    """
    folder = folder or scratch_folder(pages.sparkSession, "arc")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        size: dict[int, int] = {}
        name = {v: f"pages-v{v}.arc" for v in FIELDS}

        def close(version: int) -> pa.RecordBatch:
            parts = held.pop(version)
            row = {"archive": files.write(folder, ".arc.gz", parts), "records": len(parts) - 1}
            return pa.RecordBatch.from_pylist([row], pa.schema([("archive", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                version = 1 + (page or 0) % 2
                date = f"2000{(page or 0) % 12 + 1:02d}{(page or 0) % 28 + 1:02d}{(page or 0) % 24:02d}0000"
                payload = html.as_buffer().to_pybytes()
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
                if version not in held:
                    held[version] = [gzip.compress(arc_start(version, name[version], date), LEVEL, mtime=0)]
                    size[version] = len(held[version][0])
                record = arc_record(version, url, "0.0.0.0", date, "text/html", 200, head.encode() + payload, name[version], size[version])
                held[version].append(gzip.compress(record, LEVEL, mtime=0))
                size[version] += len(held[version][-1])
                if size[version] > FILE_BYTES:
                    yield close(version)
        for version in list(held):
            yield close(version)

    return folder, materialise(pages.mapInArrow(write, ARCHIVES))


def _record_id(record: ArcRecord, page: int | None) -> str:
    """An identifier that follows from the record, so that a repeated task gives it again."""
    named = json.dumps([record.fields["URL"], record.fields["Archive-date"], page]) + digest(record.body)
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, named)}"


def _read(content: bytes) -> Iterator[tuple[int, ArcRecord]]:
    version = 0
    for offset, record in members(content):
        if not version:
            version = arc_version(record)
        else:
            yield offset, parse_arc(record, version)


def index(folder: str, archives: DataFrame) -> DataFrame:
    """The records of the archives listed, by INDEX."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                for i, (offset, record) in enumerate(_read(bytes(content))):
                    _, fields, payload = http_parts(record.body)
                    page = int(fields["x-page-id"]) if "x-page-id" in fields else None
                    out.append((path.rsplit("/", 1)[-1], i, offset, page, _record_id(record, page), len(payload), digest(payload)))
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64"})

    spark = archives.sparkSession
    if not archives.limit(1).count():
        return spark.createDataFrame([], INDEX)
    found = spark.read.format("binaryFile").load(f"{folder}/*.arc.gz").select("path", "content").mapInPandas(rows, INDEX)
    return found.join(archives.select("archive"), "archive", "left_semi")


# ---------------------------------------------------------------- WARC


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", str(len(block)))]]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k: v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is not the declared one")
    return fields, rest[:length]


def _converted(record: ArcRecord, record_id: str, refers_to: str | None) -> bytes:
    """The WARC record equivalent to an ARC record; a revisit keeps the headers of the response alone."""
    head, _, payload = http_parts(record.body)
    d = record.fields["Archive-date"].ljust(14, "0")
    block = record.body if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", record.fields["URL"]),
        ("WARC-IP-Address", record.fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    return warc_record(fields, block)


def convert(folder: str, records: DataFrame, into: str | None = None, min_bytes: int = MIN_BYTES) -> tuple[str, DataFrame]:
    """WARC files from the archives of an index (`INDEX`); their folder and list.

    Records with equal payloads of `min_bytes` or more become revisits of the one with the largest
    page; ties for the largest, and groups without any page number, are responses. What a task needs
    to know of an archive is one row a record, without payloads.
    """
    into = into or scratch_folder(records.sparkSession, "warc")
    largest = (
        records.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "record_id")).alias("first"))
    )
    roles = records.join(largest, ["payload_digest", "payload_bytes"], "left").select(
        "archive",
        "record",
        "record_id",
        F.when(
            F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first.record_id")
        ).alias("refers_to"),
    )

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        known = {r.record: r for r in rows.itertuples()}
        archive = rows["archive"].iloc[0]
        about = f"software: legacy archive converter\r\nformat: WARC File Format 1.1\r\nsource: {archive}\r\n".encode()
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, archive)}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
        parts = [gzip.compress(warc_record(info, about), LEVEL, mtime=0)]
        for i, (_, record) in enumerate(_read(files.read(folder, archive))):
            own = known[i]
            refers_to = own.refers_to if isinstance(own.refers_to, str) else None
            parts.append(gzip.compress(_converted(record, own.record_id, refers_to), LEVEL, mtime=0))
        return pd.DataFrame({"archive": [files.write(into, ".warc.gz", parts)], "records": [len(parts) - 1]})

    return into, materialise(roles.groupBy("archive").applyInPandas(write, ARCHIVES))


def read_warc(folder: str, archives: DataFrame) -> DataFrame:
    """One row a response or revisit of the WARC files listed; refers_to is the page referred to.

    Digests are checked against what is there; a revisit gives those of the payload it stands for.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                for i, (_, record) in enumerate(members(bytes(content))):
                    fields, block = parse_warc(record)
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                        raise ValueError(f"{path}: block digest of record {i} does not hold")
                    _, http, payload = http_parts(block)
                    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http["content-length"])
                    if fields["WARC-Type"] == "response" and (digest(payload) != named or len(payload) != size):
                        raise ValueError(f"{path}: payload digest of record {i} does not hold")
                    page = int(http["x-page-id"]) if "x-page-id" in http else None
                    refers = fields.get("WARC-Refers-To", "").strip("<>") or None
                    out.append((path.rsplit("/", 1)[-1], i, page, fields["WARC-Record-ID"].strip("<>"), fields["WARC-Type"], refers, size, named))
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])
                yield frame.astype({"page_id": "Int64"})

    spark = archives.sparkSession
    if not archives.limit(1).count():
        found = spark.createDataFrame([], RECORDS)
    else:
        found = spark.read.format("binaryFile").load(f"{folder}/*.warc.gz").select("path", "content").mapInPandas(rows, RECORDS)
        found = materialise(found.join(archives.select("archive"), "archive", "left_semi"))
    whole = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    return found.join(whole, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def pages_as_warc(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages (page_id, url, html) laid out as legacy archives, converted, and read back.

    A null html is an empty payload, a null url is written as "-", a null page_id stays null and
    gives way to any other; repeated rows stay. An empty table gives an empty result.
    """
    folder, archives = archive_pages(pages)
    records = materialise(index(folder, archives))
    return read_warc(*convert(folder, records, min_bytes=min_bytes))
