"""WARC archives: a Python data source that writes and reads them.

    spark.dataSource.register(WarcSource)
    frame.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").load(folder).where("record_type = 'response'")

Columns: record_type, record_id, target_uri, page_id, refers_to, payload_digest, payload_bytes,
payload. Each task writes one file of gzip members, one record a member, and the commit lists the
files in a manifest, so files of lost or repeated tasks are never read. The header of a member
says how long it is (extra field `sl`, compressed and plain length), so a reader can pass over it.

A reader plans groups of whole files. Equality predicates on record_type, target_uri, record_id,
page_id and payload_digest are taken over by the source: the WARC headers of a record, which fill
the first bytes of a member, are decoded and tested first, and the rest of a member that is not
wanted is neither inflated nor decoded."""

from __future__ import annotations

import base64
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = (
    "record_type string, record_id string, target_uri string, page_id long, refers_to long, "
    "payload_digest string, payload_bytes long, payload binary"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
#: Bytes of archives that one reading task gets, if there are several files.
TASK_BYTES = 128 << 20
ROWS = 256
ROW_BYTES = 8 << 20
MIN_REVISIT_BYTES = 1000
MANIFEST = "manifest-"


def _files(path: str):
    """File system and path of a folder; schemes are those that pyarrow knows."""
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return arrow_fs.LocalFileSystem(), path


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _page_urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record_bytes(row: dict) -> bytes:
    """One record. Revisits have the response's HTTP headers with the full length, and no payload."""
    payload = row["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http + (payload if row["record_type"] == "response" else b"")
    headers = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id'] or f'<urn:uuid:{uuid.uuid4()}>'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        headers.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    if row["page_id"] is not None:
        headers.append(f"WARC-Page-ID: {row['page_id']}")
    headers.append(f"WARC-Payload-Digest: {_base32(row['payload_digest'])}")
    if row["record_type"] == "revisit":
        headers.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if row["refers_to"] is not None:
            headers.append(f"WARC-Refers-To: {_page_urn(row['refers_to'])}")
    headers += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 5) -> bytes:
    """A gzip member whose extra field tells its own length."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    extra = b"sl" + struct.pack("<HQQ", 16, 10 + 2 + 20 + len(body) + 8, len(data))
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.decode(errors="replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _fields(headers: dict[str, str]) -> dict:
    page, refers, digest = headers.get("warc-page-id"), headers.get("warc-refers-to"), headers.get("warc-payload-digest", "")
    return {
        "record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"),
        "target_uri": _unline(headers["warc-target-uri"]) if "warc-target-uri" in headers else None,
        "page_id": int(page) if page else None, "refers_to": int(refers.rsplit(":", 1)[1].rstrip(">")) if refers and ":page:" in refers else None,
        "payload_digest": base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None,
    }


def _payload(fields: dict, block: bytes) -> dict:
    head, _, body = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    revisit = fields["record_type"] == "revisit"
    return fields | {"payload_bytes": length if revisit else len(body), "payload": None if revisit else body}


def _decoded(fields: dict, whole: bytes, at: int, headers: dict[str, str]) -> dict:
    size = int(headers.get("content-length", 0))
    block = whole[at : at + size]
    if len(block) < size:
        raise ValueError(f"record {fields['record_id']} is cut off")
    return _payload(fields, block)


def read_members(stream, wanted, need_payload: bool = True) -> Iterator[dict]:
    """Records of a seekable stream of gzip members that `wanted` (a predicate on the fields of
    the WARC headers) lets through. Members without the extra field are inflated to their end."""
    while True:
        start = stream.tell()
        head = stream.read(32)
        if not head:
            return
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {start}")
        known = struct.unpack("<Q", head[16:24])[0] if head[3] & 4 and head[12:14] == b"sl" else None
        stream.seek(start)
        inflate = zlib.decompressobj(31)
        raw = stream.read(min(known, 4096) if known else 4096)
        taken, data = len(raw), inflate.decompress(raw)
        while b"\r\n\r\n" not in data and not inflate.eof:
            raw = stream.read(4096)
            if not raw:
                raise ValueError(f"the member at byte {start} is cut off")
            taken += len(raw)
            data += inflate.decompress(raw)
        end = data.find(b"\r\n\r\n")
        if end < 0:
            raise ValueError(f"the member at byte {start} is no record")
        headers = _headers(data[:end])
        fields = _fields(headers)
        chosen = wanted(fields)
        if known and not (chosen and need_payload):
            if chosen:
                yield fields | {"payload_bytes": None, "payload": None}
            stream.seek(start + known)
            continue
        parts = [data]
        while not inflate.eof:
            raw = stream.read(1 << 16 if known is None else max(1, start + known - start - taken))
            if not raw:
                raise ValueError(f"the member at byte {start} is cut off")
            taken += len(raw)
            parts.append(inflate.decompress(raw))
        stream.seek(start + taken - len(inflate.unused_data))
        if chosen:
            yield _decoded(fields, b"".join(parts) if need_payload else data, end + 4, headers) if need_payload else fields | {"payload_bytes": None, "payload": None}


@dataclass
class Group(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        super().__init__(tuple(files))
        self.files = files


class WarcReader(DataSourceReader):
    TAKEN = {"record_type", "record_id", "target_uri", "page_id", "payload_digest"}

    def __init__(self, path: str, options: dict):
        self.path, self.task_bytes = path, int(options.get("taskbytes", TASK_BYTES))
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.TAKEN:
                self.tests.append((f.attribute[0], [f.value]))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in self.TAKEN:
                self.tests.append((f.attribute[0], list(f.value)))
            else:
                yield f

    def partitions(self):
        system, root = _files(self.path)
        names = system.get_file_info(arrow_fs.FileSelector(root, recursive=False))
        listed = [f for f in names if posixpath.basename(f.path).startswith(MANIFEST)]
        sizes = {f.path: f.size for f in names if f.path.endswith(".warc.gz")}
        if listed:  # only what was committed
            committed = set()
            for f in listed:
                with system.open_input_stream(f.path) as s:
                    committed.update(json.loads(s.read()))
            sizes = {p: n for p, n in sizes.items() if posixpath.basename(p) in committed}
        groups, size = [[]], 0
        for path, n in sorted(sizes.items()):
            if groups[-1] and size + n > self.task_bytes:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Group(g) for g in groups]

    def read(self, partition):
        system, _ = _files(self.path)
        tests = [(name, set(values)) for name, values in self.tests]
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for path in partition.files:
            with system.open_input_file(path) as stream:
                for record in read_members(stream, lambda fields: all(fields[name] in values for name, values in tests)):
                    rows.append(record)
                    size += len(record["payload"] or b"")
                    if len(rows) >= ROWS or size >= ROW_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        system, root = _files(self.path)
        name, count = f"part-{uuid.uuid4().hex}.warc.gz", 0
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in iterator:
                out.write(gzip_member(record_bytes(row.asDict())))
                count += 1
        return Written(name, count)

    def commit(self, messages):
        system, root = _files(self.path)
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(arrow_fs.FileSelector(root))] if self.overwrite else []
        kept = [m.name for m in messages if m]
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(kept).encode())
        for path in old:
            if posixpath.basename(path) not in kept:
                system.delete_file(path)

    def abort(self, messages):
        system, root = _files(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_records(pages: DataFrame) -> DataFrame:
    """Records of (page_id, url, html), in the columns of the source.

    Of pages with equal payloads of MIN_REVISIT_BYTES or more, the largest page_id is the response
    and the others are revisits of it; a null page_id is least. Repeated rows of that page_id are
    all responses. Null html is an empty payload. Payload counts are made before rows of equal
    payloads meet; only payloads that occur twice are looked up. Other columns are ignored."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = lambda df: df.withColumn("payload_digest", F.sha1(payload)).withColumn("payload_bytes", F.octet_length(payload).cast("long"))
    shared = (
        digest(pages.select("page_id", "html")).where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("first")).where("copies > 1").select("payload_digest", "first")
    )
    joined = digest(pages.select("page_id", F.col("url").alias("target_uri"), "html")).join(shared, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">")).alias("record_id"),
        "target_uri", "page_id", F.when(revisit, F.col("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, payload).alias("payload"),
    )


def archived_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages to archives in a folder and reads them back: page_id, payload_bytes,
    payload_digest (made anew from a response's payload), record_type, refers_to."""
    spark = pages.sparkSession
    register(spark)
    archive_records(pages).write.format("warc").mode("append").save(folder)
    records = spark.read.format("warc").load(folder)
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
