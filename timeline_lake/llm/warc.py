"""ARC archives into WARC archives.

ARC files (versions 1 and 2) are read by what their version blocks say: the fields of a record line, and the length it
declares. Each record becomes a WARC response, or a revisit of the record that already holds its payload; what is no HTTP
response (a ``dns:`` record, a bare body) becomes a resource, and a version block a warcinfo record. Record id, date, type
and digests follow from the ARC record and its place in its archive, so that a repeated task writes the same bytes and no
two records share an id. Fields that WARC has no name for (those of version 2) are kept as ``X-Arc-`` headers.

Both kinds are written one gzip member per record, as the formats ask for, by Spark's own writer (see ``write_blobs``).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.shared import given, new_folder, read_blobs, write_blobs
from timeline_lake.session import cut_lineage

REVISIT_BYTES = 1000
LEVEL = 4  # of gzip
#: Records of one file: a file is read back whole by one task.
FILE_RECORDS = 2000
CRAWL_DATE = "20000101000000"
PAGE_HEADER = "X-Page-Id"
# Fixed values of the formats: the fields of a record line by version, and the revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def gzip_member(data: bytes) -> bytes:
    """One gzip member that ends with a zero byte, as ``write_blobs`` wants it.

    A member ends with its length; only one of 16 MB or more has another last byte, and gets an empty member after it.
    """
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if not out[-1] else out + gzip_member(b"")


def gunzipped(content: bytes) -> bytes:
    """The data of all members; plain content is passed on."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        unpacker = zlib.decompressobj(31)
        out.append(unpacker.decompress(rest) + unpacker.flush())
        rest = unpacker.unused_data
    return b"".join(out)


def member_chunks(content: bytes) -> Iterator[bytes]:
    """The data of one gzip member after the other, so that only one record at a time is unpacked."""
    rest = memoryview(content)
    while len(rest) and rest[:2] == b"\x1f\x8b":
        unpacker = zlib.decompressobj(31)
        data = unpacker.decompress(rest[: 1 << 16])
        parts, at = [data], min(1 << 16, len(rest))
        while not unpacker.eof and at < len(rest):
            parts.append(unpacker.decompress(rest[at : at + (1 << 20)]))
            at = min(at + (1 << 20), len(rest))
        if not unpacker.eof:
            raise ValueError("a gzip member is cut short")
        yield b"".join(parts)
        rest = rest[at - len(unpacker.unused_data) :]
    if len(rest):
        yield bytes(rest)


# --- ARC -------------------------------------------------------------------------------------------------------------


def arc_line(version: int, fields: dict[str, str]) -> bytes:
    """A record line. Fields cannot hold spaces; missing ones are written as ``-``."""
    clean = [re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), fields.get(f) or "-") for f in ARC_FIELDS[version].split()]
    return (" ".join(clean) + "\n").encode()


def arc_version_block(version: int, name: str, date: str = CRAWL_DATE) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    return arc_line(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}) + body + b"\n"


def arc_record(version: int, url: str, block: bytes, date: str = CRAWL_DATE) -> bytes:
    fields = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(block))}
    return arc_line(version, fields) + block + b"\n"


def read_arc(chunks: Iterable[bytes], version_blocks: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the record line, block) of every record, of the version block only if ``version_blocks``.

    A file's first record tells the version and names the fields. Lengths are taken as declared: what a block holds is
    not looked at. Chunks are records or whole files.
    """
    names: list[str] = []
    for data in chunks:
        at = 0
        while at < len(data):
            if data[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = data.find(b"\n", at)
            if end < 0:
                raise ValueError("a record line without an end")
            values = data[at:end].decode("utf-8").rstrip("\r").split(" ")
            length = int(values[-1])
            block = data[end + 1 : end + 1 + length]
            if len(block) != length:
                raise ValueError(f"{values[0]}: {length} bytes declared, {len(block)} found")
            at = end + 1 + length
            if values[0].startswith("filedesc://"):
                lines = block.decode("utf-8").splitlines()
                version = int(lines[0].split(" ")[0])
                names = lines[1].split(" ") if len(lines) > 1 else ARC_FIELDS[version].split(" ")
                if version_blocks:
                    own = ARC_FIELDS[1 if len(values) == 5 else 2].split(" ")
                    yield dict(zip(own, values)), block
                continue
            if not names:
                names = ARC_FIELDS[1 if len(values) == 5 else 2].split(" ")
            if len(values) != len(names):
                raise ValueError(f"{len(values)} fields for {len(names)} names: {values[0]}")
            yield dict(zip(names, values)), block


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the empty line, payload) of a stored response; a block without headers is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    crlf, lf = block.find(b"\r\n\r\n"), block.find(b"\n\n")
    if crlf >= 0 and (lf < 0 or crlf < lf):
        return block[: crlf + 4], block[crlf + 4 :]
    return (block[: lf + 2], block[lf + 2 :]) if lf >= 0 else (block, b"")


def header_value(headers: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", headers)
    return found[1].decode("utf-8") if found else None


def page_block(page_id: int | None, payload: bytes) -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"{PAGE_HEADER}: {page_id}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload


# --- WARC ------------------------------------------------------------------------------------------------------------


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(fields: dict[str, str], block: bytes, place: str = "") -> str:
    """The same for the same ARC record in every run; ``place`` names the archive and the record's number in it."""
    said = (fields["URL"], fields.get("Archive-date", ""), hashlib.sha1(block).hexdigest(), place)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(said))}>"


def record_type(fields: dict[str, str], headers: bytes) -> str:
    """What an ARC record is in WARC, as long as it is no revisit."""
    if fields["URL"].startswith("filedesc://"):
        return "warcinfo"
    return "response" if headers else "resource"


def checksum_fails(fields: dict[str, str], block: bytes) -> bool:
    """Whether the record line of version 2 holds an MD5 or SHA-1 in hex that is not the block's."""
    said = (fields.get("Checksum") or "").lower()
    made = {32: hashlib.md5, 40: hashlib.sha1}.get(len(said))
    return bool(made and re.fullmatch("[0-9a-f]+", said)) and made(block).hexdigest() != said


def warc_record(fields: dict[str, str], block: bytes, refers_to: str | None, place: str = "") -> bytes:
    """A record, or a revisit of the record ``refers_to``, which keeps the HTTP headers but not the payload."""
    headers, payload = http_parts(block)
    kind = record_type(fields, headers)
    stored = block if refers_to is None else headers
    lines = ["WARC/1.0", f"WARC-Type: {kind if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(fields, block, place)}"]
    lines.append(f"WARC-Date: {warc_date(fields.get('Archive-date', ''))}")
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {fields['URL'].removeprefix('filedesc://')}")
    else:
        lines += [f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields.get('IP-address', '-')}", f"WARC-Payload-Digest: {base32_sha1(payload)}"]
    lines.append(f"WARC-Block-Digest: {base32_sha1(stored)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines += [f"X-Arc-{name}: {value}" for name, value in fields.items() if name not in ARC_FIELDS[1].split(" ") and value != "-"]
    if checksum_fails(fields, block):
        lines.append("X-Arc-Checksum-Failed: true")
    form = {"response": "application/http; msgtype=response", "warcinfo": "text/plain"}.get(kind) or fields.get("Content-type", "application/octet-stream")
    lines += [f"Content-Type: {form}", f"Content-Length: {len(stored)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + stored + b"\r\n\r\n"


def read_warc(chunks: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(headers, block) of every record, by declared lengths."""
    for data in chunks:
        at = 0
        while at < len(data):
            if data[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            if data[at : at + 5] != b"WARC/":
                raise ValueError(f"no record at byte {at}")
            end = data.index(b"\r\n\r\n", at) + 4
            headers = data[at:end]
            length = int(header_value(headers, "Content-Length") or 0)
            block = data[end : end + length]
            if len(block) != length:
                raise ValueError("a record is cut short")
            yield headers, block
            at = end + length


# --- Spark jobs ------------------------------------------------------------------------------------------------------


def write_arc(pages: DataFrame, folder: str) -> None:
    """ARC files of FILE_RECORDS records at most; tasks alternate between the two versions. A null html is an empty payload.

    Only a task's first file has a version block; the others are told by the number of their fields.
    """

    def records(batches):
        number = TaskContext.get().partitionId()
        version = 1 + number % 2
        yield pa.RecordBatch.from_arrays([pa.array([gzip_member(arc_version_block(version, f"part-{number:05}.arc"))], pa.binary())], ["record"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, urls, htmls = (c.to_pylist() for c in batch.slice(at, 256).columns)
                out = [gzip_member(arc_record(version, u or "-", page_block(i, (h or "").encode("utf-8")))) for i, u, h in zip(ids, urls, htmls)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    asked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    write_blobs(asked.mapInArrow(records, "record binary"), "record", folder, FILE_RECORDS)


def _archive_records(batch, version_blocks: bool):
    """(place, fields, block) of the records of the archives in a batch of ``read_blobs``."""
    for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
        archive = path.rsplit("/", 1)[-1]
        for number, (fields, block) in enumerate(read_arc(member_chunks(content.as_py()), version_blocks=True)):
            if version_blocks or not fields["URL"].startswith("filedesc://"):
                yield f"{archive}#{number}", fields, block


def arc_digests(spark: SparkSession, folder: str) -> DataFrame:
    """What decides about revisits, without the blocks: page_id, place, record_id, payload_bytes, payload_digest."""

    def rows(batches):
        for batch in batches:
            out = []
            for place, fields, block in _archive_records(batch, version_blocks=False):
                headers, payload = http_parts(block)
                page = header_value(headers, PAGE_HEADER)
                out.append((int(page) if page else None, place, record_id(fields, block, place), len(payload), hashlib.sha1(payload).hexdigest()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "place", "record_id", "payload_bytes", "payload_digest"])

    return read_blobs(spark, folder).mapInArrow(rows, "page_id long, place string, record_id string, payload_bytes long, payload_digest string")


_FIELDS = pa.map_(pa.string(), pa.string())


def arc_records(spark: SparkSession, folder: str) -> DataFrame:
    """place, fields (a map), block of every ARC record, version blocks included."""

    def rows(batches):
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for place, fields, block in _archive_records(batch, version_blocks=True):
                held.append((place, list(fields.items()), block))
                size += len(block)
                if size > 1 << 22:
                    yield _records(held)
                    held, size = [], 0
            if held:
                yield _records(held)

    return read_blobs(spark, folder).mapInArrow(rows, "place string, fields map<string,string>, block binary")


def _records(held: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*held))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), _FIELDS, pa.binary()))], ["place", "fields", "block"])


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = REVISIT_BYTES) -> None:
    """ARC files to WARC files.

    Of records with one payload of at least ``least_bytes``, one with the largest page id is the response and those with
    other page ids revisit it; repeated records of that page are responses as well. Records without a page id are never
    revisits and are not referred to. Only records that revisit are looked up, by their place; copies are added up per task
    before digests are shuffled.
    """
    digests = cut_lineage(arc_digests(spark, arc_folder))
    large = digests.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    key = ["payload_digest", "payload_bytes"]
    groups = large.groupBy(*key).agg(F.max(F.struct("page_id", "record_id")).alias("_top"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    revisits = large.join(groups, key).filter("page_id <> _top.page_id")
    revisits = cut_lineage(revisits.select("place", F.col("_top.record_id").alias("refers_to")))

    def records(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256).to_pylist()
                out = [gzip_member(warc_record(dict(r["fields"]), r["block"], r["refers_to"], r["place"])) for r in some]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    joined = arc_records(spark, arc_folder).join(revisits, "place", "left").select("place", "fields", "block", "refers_to")
    write_blobs(joined.mapInArrow(records, "record binary"), "record", warc_folder, FILE_RECORDS)


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, record_id, target of every WARC record but warcinfo ones.

    For a revisit the length and the digest are those of the payload it stands for.
    """

    def rows(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "target"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for content in batch.column(1):
                out = []
                for headers, block in read_warc(member_chunks(content.as_py())):
                    http, payload = http_parts(block)
                    kind = header_value(headers, "WARC-Type")
                    if kind == "warcinfo":
                        continue
                    digest = header_value(headers, "WARC-Payload-Digest") or ""
                    if kind != "revisit" and digest != base32_sha1(payload):
                        raise ValueError(f"{header_value(headers, 'WARC-Record-ID')}: the payload does not have its digest")
                    page = header_value(http, PAGE_HEADER)
                    size = len(payload) if kind != "revisit" else int(header_value(http, "Content-Length") or 0)
                    out.append((
                        int(page) if page else None, size, base64.b32decode(digest.removeprefix("sha1:")).hex(), kind,
                        header_value(headers, "WARC-Record-ID"), header_value(headers, "WARC-Refers-To"),
                    ))
                columns = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, target string"
    return read_blobs(spark, folder).mapInArrow(rows, schema)


def op2_warc_from_arc(spark: SparkSession, folder: str) -> DataFrame:
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(given(spark, folder, "pages"), arc)
    convert(spark, arc, warc)
    found = cut_lineage(read_back(spark, warc))
    meant = found.filter("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    referring = found.filter("target is not null").join(meant, "target")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return referring.select(*columns).unionByName(found.filter("target is null").withColumn("refers_to", F.lit(None).cast("long")).select(*columns))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (h)
"""
