"""Legacy web archives (ARC) converted to WARC, written to shared storage and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, table

#: Fields of a record line by ARC version, as the format's description lists them.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: A writer starts a new file beyond this many bytes.
FILE_BYTES = 64 << 20


@dataclass
class ArcRecord:
    """A record's named fields and its declared bytes."""

    version: int
    fields: dict[str, str]
    content: bytes


def write_arc(records: Iterable[ArcRecord], version: int, date: str = "20000101000000", name: str = "pages.arc") -> bytes:
    """An ARC file: a version block that names the fields, then the records."""
    out = io.BytesIO()
    body = f"{version} 0 Own\n{' '.join({1: ('URL', 'IP-address', 'Archive-date', 'Content-type', 'Archive-length'), 2: ('URL', 'IP-address', 'Archive-date', 'Content-type', 'Result-code', 'Checksum', 'Location', 'Offset', 'Filename', 'Archive-length')}[version])}\n".encode()
    head = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "content_type": "text/plain", "result_code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name}
    for fields, content in [(head, body), *((r.fields, r.content) for r in records)]:
        line = {**fields, "offset": str(out.tell()), "length": str(len(content))}
        out.write(" ".join(line[f] for f in FIELDS[version]).encode() + b"\n" + content + b"\n")
    return out.getvalue()


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an ARC stream, each as long as its line declares.

    The version block says how the lines of this file are laid out; it must come
    first. A line with another number of fields (URLs may hold spaces) is read
    from its right end. ValueError for a line or a length that does not fit.
    """
    version = 0
    while line := stream.readline():
        line = line.strip(b"\r\n")
        if not line:
            continue
        words = line.decode("utf-8", "replace").split(" ")
        names = FIELDS[version or 1]
        if not version and len(words) == len(FIELDS[2]):
            names = FIELDS[2]
        if len(words) < len(names) or not words[-1].isdigit():
            raise ValueError(f"no ARC record line: {line[:200]!r}")
        tail = words[len(words) - len(names) + 1 :]
        fields = dict(zip(names, [" ".join(words[: len(words) - len(tail)]), *tail], strict=True))
        content = stream.read(int(fields["length"]))
        if len(content) < int(fields["length"]):
            raise ValueError(f"{fields['url']} declares {fields['length']} bytes, {len(content)} are left")
        if not version:
            if not fields["url"].startswith("filedesc:"):
                raise ValueError("no version block")
            version = int(content.split(None, 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        yield ArcRecord(version, fields, content)


def record_id(url: str, date: str, payload_digest: str, source_id: int | None) -> str:
    """A URN that is the same for the same record. It also holds the source's 64-bit id
    (none: the lowest bit)."""
    h = int.from_bytes(hashlib.sha1(f"{url} {date} {payload_digest}".encode()).digest()[:8], "big")
    rest = (h >> 7 << 1) | (source_id is None)
    bits = ((source_id or 0) & (2**64 - 1)) << 58 | rest & (2**58 - 1)
    value = bits >> 74 << 80 | 8 << 76 | (bits >> 62 & 0xFFF) << 64 | 2 << 62 | bits & (2**62 - 1)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def source_id(urn: str) -> int | None:
    """The id inside ``record_id``."""
    value = uuid.UUID(urn.strip("<>")).int
    bits = value >> 80 << 74 | (value >> 64 & 0xFFF) << 62 | value & (2**62 - 1)
    return None if bits & 1 else struct.unpack(">q", (bits >> 58).to_bytes(8, "big"))[0]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header (with its blank line) and payload of a response; no header: all is payload."""
    if content.startswith(b"HTTP/"):
        at = min((m.end() for m in (re.search(rb"\r?\n\r?\n", content),) if m), default=-1)
        if at >= 0:
            return content[:at], content[at:]
    return b"", content


def to_warc(record: ArcRecord, ident: int | None = None, original: str | None = None) -> bytes:
    """The WARC record of an ARC record, as one gzip member.

    A web response becomes ``response``, or ``revisit`` where ``original`` is the record
    id of another record with the same payload; what has no HTTP header
    becomes ``resource``. Digests are SHA-1 in base 32 over payload and block.
    """
    f = record.fields
    d = f["date"].ljust(14, "0")[:14]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    head, payload = split_http(record.content)
    revisit = original is not None
    kind = "revisit" if revisit else "response" if head else "resource"
    block = head if revisit else record.content
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(f["url"], d, digest(payload), ident),
        "WARC-Date": date,
        "WARC-Target-URI": f["url"].replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-IP-Address": f["ip"],
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if f["ip"] in ("-", "0.0.0.0"):
        del lines["WARC-IP-Address"]
    if revisit:
        lines |= {"WARC-Profile": PROFILE, "WARC-Refers-To": original}
    lines |= {"Content-Type": "application/http;msgtype=response" if head else f["content_type"], "Content-Length": str(len(block))}
    raw = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream, plain or gzip, one at a time."""
    reader = stream if hasattr(stream, "peek") else io.BufferedReader(stream, 1 << 20)
    if reader.peek(2)[:2] == b"\x1f\x8b":
        reader = io.BufferedReader(gzip.GzipFile(fileobj=reader), 1 << 20)
    while line := reader.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:100]!r}")
        headers: dict[str, str] = {}
        while (line := reader.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = reader.read(n)
        if len(block) < n:
            raise ValueError(f"{headers.get('warc-record-id')} declares {n} bytes, {len(block)} are left")
        yield headers, block


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def legacy_fields(url: str | None, number: int) -> dict[str, str]:
    """URL and date of a page in an old archive."""
    date = time.strftime("%Y%m%d%H%M%S", time.gmtime(946_684_800 + number % 600_000_000))
    return {"url": "-" if not url else re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url), "date": date}


def legacy_record(url: str | None, payload: bytes, number: int) -> ArcRecord:
    """A page as an old crawler would have stored it; odd numbers in the second version."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = legacy_fields(url, number) | {"ip": "0.0.0.0", "content_type": "text/html", "result_code": "200", "checksum": f"{zlib.crc32(payload):08x}", "location": "-", "filename": "pages.arc"}
    return ArcRecord(1 + number % 2, fields, head + payload)


def originals(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Payloads that occur more than once: their SHA-256, and the smallest id (nulls last) with its URL."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    named = F.when(F.col(key).isNotNull(), F.struct(F.col(key).cast("long").alias("first"), F.col(url).alias("first_url")))
    found = pages.groupBy(F.sha2(body, 256).alias("sha")).agg(F.min(named).alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.select("sha", "of.first", "of.first_url")


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """A WARC record for each page in gzip files below the shared folder; returns the
    list of files (path, records, bytes).

    Every page first takes the form of an ARC record and goes through the
    converter. Of equal payloads the one with the smallest id is a response, the
    others revisit it (repeated ids are all responses; a null id revisits where
    there is another). A task writes under its attempt's name and renames when
    complete, so retried or duplicated attempts leave nothing in the list.
    """
    folder = shared_dir(pages.sparkSession) + "/warc"
    first = table(originals(pages, key, url, payload))
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("sha")).join(first, "sha", "left")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        name, part, out, n, size = "", 0, None, 0, 0

        def close():
            nonlocal out, part, n, size
            out.close()
            store.move(f"{name}.tmp", name)
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})
            out, part, n, size = None, part + 1, 0, 0
            return done

        for batch in batches:
            ids, urls, firsts, first_urls = (batch.column(c).to_pylist() for c in ("id", "url", "first", "first_url"))
            for i, x in enumerate(batch.column("payload")):
                payload = x.as_buffer().to_pybytes()
                legacy = legacy_record(urls[i], payload, zlib.crc32(payload) if ids[i] is None else ids[i])
                (record,) = read_arc(io.BytesIO(write_arc([legacy], legacy.version, legacy.fields["date"])))
                original = None
                if firsts[i] is not None and firsts[i] != ids[i]:
                    of = legacy_fields(first_urls[i], firsts[i])
                    original = record_id(of["url"], of["date"], digest(payload), firsts[i])
                raw = to_warc(record, ids[i], original)
                if out is None:
                    name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{part}.warc.gz"
                    out = store.open_output_stream(f"{name}.tmp")
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= FILE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    return table(rows.select("id", "url", "payload", "first", "first_url").mapInArrow(run, "path string, records long, bytes long"))


def read_archives(files: DataFrame) -> DataFrame:
    """The records of WARC files (column path), one row each: page_id, url, warc_date,
    record_id, record_type, refers_to, payload_bytes, payload_digest.

    Files are streamed, a record at a time. The digest of a response's payload is
    computed from the bytes read and must agree with its header. The record that a
    revisit refers to is looked up by its record id among all that were read: it
    must be there, with the length and digest that the revisit states.
    """
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("original", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def one(h: dict[str, str], block: bytes) -> dict:
        head, payload = split_http(block)
        stated = h["warc-payload-digest"].removeprefix("sha1:")
        revisit = h["warc-type"] == "revisit"
        if revisit:
            size = int(re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)[1])
        else:
            size = len(payload)
            if digest(payload) != stated:
                raise ValueError(f"{h['warc-record-id']}: the payload has another digest")
        return {"page_id": source_id(h["warc-record-id"]), "url": h.get("warc-target-uri"), "warc_date": h["warc-date"], "record_id": h["warc-record-id"], "record_type": h["warc-type"], "original": h["warc-refers-to"] if revisit else None, "payload_bytes": size, "payload_digest": stated}

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = _open(path)
                rows = []
                with store.open_input_stream(at, compression=None) as stream:
                    for h, block in read_warc(stream):
                        rows.append(one(h, block))
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, kind)

    n = max(1, files.count())
    found = table(files.select("path").repartition(n).mapInArrow(run, "page_id long, url string, warc_date string, record_id string, record_type string, original string, payload_bytes long, payload_digest string"))
    # Rows that repeat have equal records; a hot original is one row here.
    kept = found.where("record_type != 'revisit'").groupBy(F.col("record_id").alias("original")).agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("bytes"), F.first("payload_digest").alias("digest"))
    revisits = found.where("record_type = 'revisit'").join(table(kept), "original", "left")
    wrong = F.col("bytes").isNull() | (F.col("bytes") != F.col("payload_bytes")) | (F.col("digest") != F.col("payload_digest"))
    said = F.concat(F.col("record_id"), F.lit(" refers to "), F.col("original"), F.lit(", which is not there or another payload"))
    columns = ["page_id", "url", "warc_date", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    resolved = revisits.withColumn("record_type", F.when(wrong, F.raise_error(said).cast("string")).otherwise(F.col("record_type")))
    return found.where("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(resolved.select(columns))
