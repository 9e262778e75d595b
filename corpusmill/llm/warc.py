"""WARC archives as a PySpark Python data source, for reading and writing.

Reading plans partitions of whole files (small ones together, up to
``partitionBytes``). Predicates on the record type and other header columns are
pushed down: a task parses a record's header first, and a record that fails a
predicate is skipped without its block being read. In ``.warc`` files the
header's Content-Length says how far; in ``.warc.gz`` files (one gzip member
per record) the member's skip-length extra field does, so that only the first
bytes of the member are inflated. Members without that field are inflated to
find their end. The option ``payload`` says what becomes of the blocks of the
records that pass: ``read`` (the column ``payload``), ``check`` (decoded and
held against length and digest in the header, not returned) or ``skip``.

Writing makes one gzip member per record with a skip length. Tasks write under
names that readers pass over; the files get their names when the job commits,
so a task that is run twice, or lost with its executor, leaves no record behind.

Paths may be anything that pyarrow's file systems know by URI, or local.

Payloads that occur several times are stored once: of equal payloads of
``least`` bytes or more, the record with the largest id is the ``response``, and
the others are ``revisit`` records that refer to it. Only (id, digest, length)
is grouped; the payloads move once, to meet their record type.

Defined results: a null payload counts as empty. Null ids come before all
others. Rows that agree in id and payload are ties: all of them are responses,
or all of them revisits. A null or empty URL leaves the header out; characters that a
header can't hold are percent-encoded. An empty table gives an archive without
records. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition,
                                    IsNotNull, IsNull, StringStartsWith, WriterCommitMessage)

from corpusmill.llm.common import shared_path, table

#: column -> header field (fixed values of the format; the last is an extension)
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
          "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
          "payload_length": "X-Payload-Length"}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS if c != "payload_length") + ", payload_length long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_GZIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"  # deflate, extra field, no time, unknown system
_HEAD = 4096  # bytes in which most headers end
_BATCH = 8 << 20


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records ---------------------------------------------------------------

def _member(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = len(_GZIP) + 14 + len(body)
    if size >> 32 or len(record) >> 32:  # too long for the field: readers inflate it
        return _GZIP.replace(b"\x08\x04", b"\x08\x00", 1) + body
    return _GZIP + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record)) + body


def encode_record(fields: dict[str, str | None], block: bytes) -> bytes:
    """``fields`` by header name; those without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:60]!r}")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t"):  # goes on from the line before
            out[name] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _plain_records(f) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        data = f.read(_HEAD)
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = f.read(len(data))
            if not more:
                if data.strip():
                    raise ValueError("the last header doesn't end")
                return
            data += more
        head = _parsed(data[:end])
        start, length = at + end + 4, int(head["content-length"])

        def block(start=start, length=length):
            f.seek(start)
            return f.read(length)

        yield head, block
        at = start + length + 4


def _inflated(member: bytes, most: int = 0) -> bytes:
    return zlib.decompressobj(31).decompress(member, most)


def _gzip_records(f) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        data = f.read(_HEAD)
        known = len(data) >= 24 and data[:4] == _GZIP[:4] and data[12:14] == b"sl"
        if known:
            length = struct.unpack("<I", data[16:20])[0]
            member = data[:length]
            record, whole = _inflated(member, _HEAD), None
        else:
            z, parts = zlib.decompressobj(31), []
            length = 0
            while not z.eof:
                if not data:
                    raise ValueError("the last gzip member doesn't end")
                parts.append(z.decompress(data))
                length += len(data) - len(z.unused_data)
                data = f.read(1 << 20) if not z.eof else b""
            record = whole = b"".join(parts)
        end = record.find(b"\r\n\r\n")
        if end < 0 and known:  # a very long header
            f.seek(at)
            record = whole = _inflated(f.read(length))
            end = record.find(b"\r\n\r\n")
        head = _parsed(record[:end])

        def block(at=at, length=length, whole=whole, start=end + 4, size=int(head["content-length"])):
            if whole is None:
                f.seek(at)
                whole = _inflated(f.read(length))
            return whole[start:start + size]

        yield head, block
        at += length


def _payload(head: dict[str, str], block: bytes) -> bytes:
    """The payload of a block: without the HTTP head of a response."""
    if head.get("content-type", "").replace(" ", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


# ---- reading ---------------------------------------------------------------

def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "read")
        self.most = int(options.get("partitionBytes", 128 << 20))
        if self.payload not in ("read", "check", "skip"):
            raise ValueError("payload must be read, check or skip")
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            kind = type(f)
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in FIELDS and column != "payload_length" and kind in (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith):
                value = () if kind in (IsNull, IsNotNull) else f.value
                self.tests.append((FIELDS[column].lower(), kind.__name__, tuple(value) if kind in (In, IsNull, IsNotNull) else (value,)))
            else:
                yield f

    def passes(self, head: dict[str, str]) -> bool:
        for field, kind, values in self.tests:
            v = head.get(field)
            if kind == "IsNull":
                ok = v is None
            elif kind == "IsNotNull":
                ok = v is not None
            elif kind == "StringStartsWith":
                ok = v is not None and v.startswith(values[0])
            else:
                ok = v in values and (v is not None or kind == "EqualNullSafe")
            if not ok:
                return False
        return True

    def partitions(self):
        fs, root = _filesystem(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file]
        out, size = [], 0
        for i in sorted(files, key=lambda i: i.path):
            if not i.base_name.startswith(("_", ".")) and i.path.endswith((".warc", ".warc.gz")):
                if not out or size + i.size > self.most:
                    out.append(_Files([]))
                    size = 0
                out[-1].paths.append(i.path)
                size += i.size
        return out or [_Files([])]

    def read(self, partition):
        fs, _ = _filesystem(self.path)
        schema = pa.schema([(c, pa.int64() if c == "payload_length" else pa.string()) for c in FIELDS] + [("payload", pa.binary())])
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for head, block in (_gzip_records if path.endswith(".gz") else _plain_records)(f):
                    if not self.passes(head):
                        continue
                    row = [head.get(h.lower()) for h in FIELDS.values()]
                    length = int(row[-1]) if row[-1] else None
                    payload = None
                    if self.payload != "skip" and head.get("warc-type") != "revisit":
                        payload = _payload(head, block())
                        digest = (head.get("warc-payload-digest") or "").rpartition(":")[2]
                        if self.payload == "check" and (length not in (None, len(payload)) or digest and digest != payload_digest(payload)):
                            raise ValueError(f"{path}: {head.get('warc-record-id')} is not what its header says")
                        length = len(payload)
                    rows.append((*row[:-1], length, payload if self.payload == "read" else None))
                    size += 500 + len(rows[-1][-1] or b"")
                    if size > _BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


# ---- writing ---------------------------------------------------------------

@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Rows of SCHEMA's columns (any that are there, ``payload`` among them)."""

    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("fileBytes", 256 << 20))

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        part, attempt, names = TaskContext.get().partitionId(), uuid.uuid4().hex, []
        out = None
        for b in iterator:
            columns = {n: b.column(n) for n in b.schema.names}
            for k in range(b.num_rows):
                row = {n: c[k].as_py() for n, c in columns.items()}
                payload = row.pop("payload", None) or b""
                if out is None:
                    name = f"records-{part:06}-{len(names):03}-{attempt}.warc.gz"
                    names.append((f"{root}/_{name}", f"{root}/{name}"))
                    out = fs.open_output_stream(names[-1][0], compression=None)  # members are compressed one by one
                out.write(_member(self.record(row, payload)))
                if out.tell() > self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(names)

    @staticmethod
    def record(row: dict, payload: bytes) -> bytes:
        fields = {FIELDS[c]: None if v is None else quote(str(v), safe="%/:=&?~#+!$,;'@()*[]<> ") for c, v in row.items() if c in FIELDS}
        fields = {FIELDS["record_type"]: fields.pop(FIELDS["record_type"], None) or "resource"} | fields
        fields[FIELDS["payload_length"]] = fields.get(FIELDS["payload_length"]) or str(len(payload))
        digest = fields.get(FIELDS["payload_digest"]) or ""
        if len(digest) == 40 and ":" not in digest:  # in hex, as Spark's sha1() gives it
            fields[FIELDS["payload_digest"]] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
        if fields["WARC-Type"] == "revisit":
            return encode_record(fields | {"WARC-Profile": _PROFILE, "Content-Type": "application/http;msgtype=response"}, _HTTP % int(fields["X-Payload-Length"]))
        fields[FIELDS["payload_digest"]] = fields.get(FIELDS["payload_digest"]) or "sha1:" + payload_digest(payload)
        if fields["WARC-Type"] == "response":
            return encode_record(fields | {"Content-Type": "application/http;msgtype=response"}, _HTTP % len(payload) + payload)
        return encode_record(fields, payload)

    def commit(self, messages):
        fs, _ = _filesystem(self.path)
        for m in messages:
            for old, new in m.names if m else []:
                fs.move(old, new)

    def abort(self, messages):
        fs, _ = _filesystem(self.path)
        for m in messages:
            for old, _new in m.names if m else []:
                if fs.get_file_info(old).is_file:
                    fs.delete_file(old)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def read(spark, path: str, **options) -> DataFrame:
    """Records of all archives below ``path``."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def write(records: DataFrame, path: str, **options) -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").options(**options).save(path)


# ---- pages -----------------------------------------------------------------

_PREFIX = "<urn:x-page:"


def _urn(page_id):
    return F.concat(F.lit(_PREFIX), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _page_id(urn: str):
    return F.expr(f"try_cast(regexp_extract({urn}, '(-?[0-9]+)>$', 1) as bigint)")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0,
                 date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records to write: responses, and revisits of equal payloads."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload")).withColumn(
        "length", F.octet_length("payload").cast("long"))
    narrow = rows.select("id", "sha1", "length").where(F.col("length") >= least)
    groups = narrow.groupBy("sha1", "length").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = narrow.join(groups, ["sha1", "length"]).where(~F.col("id").eqNullSafe(F.col("last"))).select(
        F.col("id").alias("r_id"), F.col("sha1").alias("r_sha1"), "last").distinct()
    typed = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left")
    again = F.col("last").isNotNull()
    # a revisit's digest stands in its header; a response's is taken from its payload
    return typed.select(_urn(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
                        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.when(again, F.col("sha1")).alias("payload_digest"),
                        F.when(again, _urn(F.col("last"))).alias("refers_to"), F.col("length").alias("payload_length"),
                        F.when(~again, F.col("payload")).alias("payload"))


def op6_warc_pages(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write(page_records(table(spark, sf_dir, "pages")), path)
    # the predicates reach the headers: revisits are told without a block, and only responses are decoded
    revisits = read(spark, path, payload="skip").where("record_type = 'revisit'")
    back = revisits.unionByName(read(spark, path, payload="check").where("record_type = 'response'"))
    return back.select(_page_id("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
                       F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", _page_id("refers_to").alias("refers_to"))
