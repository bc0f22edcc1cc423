"""WARC archives as a PySpark data source.

``spark.dataSource.register(WarcSource)`` (or ``register(spark)``) gives the format ``warc``:

* read: one partition per archive file (``.warc.gz`` and ``.warc``, sub-folders included, its own or other tools'),
  read in pieces of bounded size. Comparisons of ``record_type``, ``record_id``, ``target_uri``,
  ``payload_digest``, ``payload_length`` and ``refers_to`` with constants are pushed down. The header of a
  record is parsed first; of a record that the predicates exclude nothing else is decoded, and its
  compressed bytes are skipped by the lengths that each gzip member carries (the ``sl`` extra field;
  members without it are inflated in pieces and thrown away, plain records are passed over). ``payload=false`` leaves the payload column null, ``verify=true``
  compares each payload with its digest.
* write: each task writes one archive per ``rollbytes`` bytes under a name of its own; the driver lists
  the files of the tasks that count in ``_files-*.json`` when all have ended. Files of lost or repeated
  attempts (``part-*.warc.gz``) are in no list of their folder and are not read; archives of other names are.

``path`` may be any address that pyarrow's file systems open; it must be shared by all machines.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import sys
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"
#: Rows and payload bytes in one Arrow batch of a read.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000
#: Bytes read from a file at once, handed to the inflater at once, and inflated at once while a header is looked for.
READ, SLICE, STEP = 1 << 20, 1 << 15, 2048
#: A header that has not ended after so many bytes is none.
LONGEST_HEAD = 1 << 20


def file_system(path: str):
    """(file system, path on it)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int = 1) -> bytes:
    """``record`` as a gzip member that carries its own compressed and full length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    # magic, deflate, extra field, no time, no flags, unknown system; then the extra field: "sl", 8 bytes, both lengths
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """A header value on one line: control characters as percent escapes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, uri: str | None, payload: bytes | None, length: int, payload_digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header only; its Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_clean(refers_to or '')}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict:
    out = {}
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


class Source:
    """An archive read in pieces of bounded size."""

    def __init__(self, file):
        self.file, self.size, self.start, self.held = file, file.size(), 0, b""

    @staticmethod
    def of(data) -> Source:
        return data if isinstance(data, Source) else Source(pa.BufferReader(data))

    def some(self, at: int, most: int = SLICE) -> bytes:
        """Up to ``most`` bytes from ``at`` on, as many as the piece that is held has; none at the end."""
        i = at - self.start
        if not 0 <= i < len(self.held):
            self.file.seek(min(at, self.size))
            self.start, self.held, i = at, self.file.read(READ), 0
        return self.held[i:i + most]

    def ahead(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, also where they lie in two pieces; fewer at the end of the archive only."""
        out = b""
        while len(out) < n and (more := self.some(at + len(out), n - len(out))):
            out += more
        return out

    def need(self, at: int, n: int) -> bytes:
        out = self.ahead(at, n)
        if len(out) < n:
            raise ValueError(f"the archive ends inside the gzip header at byte {at}")
        return out


class Text:
    """Decoded text with records one after another, made only as far as it is asked for.

    ``out`` is what has been made and not been taken yet, ``used`` what has been taken or skipped.
    """

    def __init__(self):
        self.out, self.used = bytearray(), 0

    def more(self, most: int) -> bool:
        """Adds to ``out`` up to ``most`` bytes, at least one; False at the end."""
        raise NotImplementedError

    def until_blank(self, most: int) -> int | None:
        """Bytes up to the end of the first empty line, looked for in the next ``most`` bytes."""
        seen = 0
        while True:
            i = self.out.find(b"\r\n\r\n", max(0, seen - 3), most)
            if i >= 0:
                return i + 4
            seen = len(self.out)
            if seen >= most or not self.more(STEP):
                return None

    def take(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more(min(n - len(self.out), READ)):
                raise ValueError("the archive ends inside a record")
        got = bytes(self.out[:n])
        del self.out[:n]
        self.used += n
        return got

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.out and not self.more(READ):
                raise ValueError("the archive ends inside a record")
            k = min(n, len(self.out))
            del self.out[:k]
            self.used += k
            n -= k

    def head(self) -> bytes | None:
        """Header of the next record; None when there is none left."""
        while not self.out or self.out[0] in b"\r\n":
            if self.out:
                self.skip(1)
            elif not self.more(STEP):
                return None
        n = self.until_blank(LONGEST_HEAD)
        if n is None or not self.out.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {bytes(self.out[:40])!r}")
        return self.take(n)[:-4]

    def last(self, left: int) -> bool:
        """Whether the record that has ``left`` bytes of its block to come is known to be the last one."""
        return False

    def next(self) -> int:
        """Where in the archive the text ends."""
        raise NotImplementedError


class Plain(Text):
    """The rest of an archive that is not compressed; what is skipped is not read."""

    def __init__(self, source: Source, at: int):
        super().__init__()
        self.source, self.body = source, at

    def more(self, most):
        got = self.source.some(self.body, most)
        self.body += len(got)
        self.out += got
        return bool(got)

    def skip(self, n):
        k = min(n, len(self.out))
        del self.out[:k]
        self.used += n
        self.body += n - k
        if self.body > self.source.size:
            raise ValueError("the archive ends inside a record")

    def next(self):
        return self.source.size


class Member(Text):
    """A gzip member at ``at``. With both its lengths in the header its end is known without inflating it."""

    def __init__(self, data, at: int):
        super().__init__()
        source = Source.of(data)
        if source.ahead(at, 3) != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        self.source, self.at, self.size, self.full = source, at, None, None
        flags, body = source.need(at, 10)[3], at + 10
        if flags & 4:
            n = struct.unpack("<H", source.need(body, 2))[0]
            extra, body = source.need(body + 2, n), body + 2 + n
            while len(extra) >= 4:
                m = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and m == 8 and len(extra) >= 12:
                    self.size, self.full = struct.unpack_from("<II", extra, 4)
                extra = extra[4 + m:]
        for bit in (8, 16):
            if flags & bit:
                while source.need(body, 1) != b"\0":
                    body += 1
                body += 1
        self.body = body + 2 if flags & 2 else body
        self.z, self.rest = zlib.decompressobj(-15), b""

    def more(self, most):
        while not self.z.eof:
            if not self.rest:
                self.rest = self.source.some(self.body)
                self.body += len(self.rest)
                if not self.rest:
                    raise ValueError(f"the archive ends inside the member at byte {self.at}")
            got = self.z.decompress(self.rest, most)
            self.rest = self.z.unconsumed_tail
            if got:
                self.out += got
                return True
        return False

    def last(self, left):
        # two line ends close a record
        return self.full is not None and (self.used + left + 4) & 0xFFFFFFFF == self.full

    def next(self):
        if self.size:
            return self.at + self.size
        while self.more(READ):
            self.out.clear()
        return self.body - len(self.z.unused_data) + 8


def records(text: Text, wanted, with_payload: bool, verify: bool):
    """Rows of the records in one text; see ``parse``."""
    while (head := text.head()) is not None:
        h = _headers(head)
        left = int(h.get("content-length", 0))
        http = {}
        if h.get("content-type", "").lower().startswith("application/http"):
            n = text.until_blank(min(left, LONGEST_HEAD))
            if n is not None:
                http, left = _headers(text.take(n)[:-4]), left - n
        said = h.get("warc-payload-digest", "")
        row = {"record_type": h.get("warc-type"), "record_id": _bare(h.get("warc-record-id")), "target_uri": _bare(h.get("warc-target-uri")),
               "payload_digest": said.partition(":")[2] if said else None, "refers_to": _bare(h.get("warc-refers-to")), "payload": None}
        # a revisit tells the length of a payload that it does not hold
        whole = http.get("content-length", "") if row["record_type"] == "revisit" else ""
        row["payload_length"] = int(whole) if whole.isdecimal() else left
        if wanted(row):
            if row["record_type"] != "revisit" and (with_payload or verify):
                payload, left = text.take(left), 0
                if verify and said.lower().startswith("sha1:") and digest(payload) != row["payload_digest"].upper():
                    raise ValueError(f"payload of {row['record_id']} does not match its header")
                row["payload"] = payload if with_payload else None
            yield row
        if text.last(left):
            return
        text.skip(left)


def parse(data, wanted, with_payload: bool, verify: bool):
    """Rows of an archive (bytes or a ``Source``); ``wanted(fields)`` decides on the header alone.

    The archive is gzip members, with one record or several in each, or plain records. Of HTTP records the payload
    is what follows the HTTP header, of others the whole block. An archive that is cut off or holds something else
    is an error. ``verify`` compares SHA-1 digests and passes over others.
    """
    source, at = Source.of(data), 0
    while at < source.size:
        text = Member(source, at) if source.ahead(at, 2) == b"\x1f\x8b" else Plain(source, at)
        yield from records(text, wanted, with_payload, verify)
        at = text.next()


_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}


@dataclass
class Archive(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tests = options["path"], []
        self.with_payload, self.verify = options.get("payload", "true").lower() == "true", options.get("verify", "false").lower() == "true"

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None if hasattr(f, "attribute") else None
            if column == "payload" or column is None:
                yield f
            elif isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((column, "null", isinstance(f, IsNull)))
            elif type(f) in _TESTS:
                self.tests.append((column, type(f).__name__, f.value))
            else:
                yield f

    def wanted(self, row) -> bool:
        tests = {k.__name__: v for k, v in _TESTS.items()}
        for column, name, value in self.tests:
            if name == "null":
                if (row[column] is None) != value:
                    return False
            elif row[column] is None or not tests[name](row[column], value):
                return False
        return True

    def partitions(self):
        from pyarrow import fs
        system, path = file_system(self.path)
        if system.get_file_info(path).is_file:
            return [Archive(path)]
        found = [f for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True)) if f.is_file]
        folder = lambda f: f.path.rpartition("/")[0]
        listed = {}
        for f in found:
            if f.base_name.startswith("_files-"):
                with system.open_input_stream(f.path) as lines:
                    listed.setdefault(folder(f), set()).update(json.loads(lines.read()))
        def counts(f):
            own = f.base_name.startswith("part-") and f.base_name.endswith(".warc.gz") and folder(f) in listed
            return f.base_name in listed[folder(f)] if own else f.base_name.endswith((".warc.gz", ".warc"))
        return [Archive(p) for p in sorted(f.path for f in found if counts(f))] or [Archive("")]

    def read(self, partition):
        if not partition.file:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.file) as f:
            rows, held = [], 0
            for row in parse(Source(f), self.wanted, self.with_payload, self.verify):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows):
        kinds = {"payload_length": pa.int64(), "payload": pa.binary()}
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.roll = int(options.get("rollbytes", 64_000_000))

    def write(self, iterator):
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        files, out, held = [], None, 0
        try:
            for batch in iterator:
                cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    r = {n: c[i].as_py() for n, c in cols.items()}
                    if out is None:
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, held = system.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                    held += out.write(member(record(r["record_type"], r["record_id"], r["target_uri"], r["payload"], r["payload_length"], r["payload_digest"],
                                                    r["refers_to"], self.date)))
                    if held >= self.roll:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/_files-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages):
        system, path = file_system(self.path)
        for m in messages:
            for n in m.files if m else ():
                system.delete_file(f"{path}/{n}")


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


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits: 8 groups of 20 bits, 4 letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = []
    for g in range(8):
        v = F.conv(F.substring(hexadecimal, g * 5 + 1, 5), 16, 10).cast("int")
        groups += [F.substr(F.lit(letters), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*groups)


def records_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Rows of ``SCHEMA`` for pages: each payload once, the other pages with it as revisits.

    Of the pages with one payload of at least ``least`` bytes that with the largest id is the response.
    A null html is an empty payload, a null id the smallest; a page given twice with one payload is
    written twice as it is. The largest id of each digest is found on (id, digest) rows counted before the shuffle.
    Payloads move once, by digest, to meet it; a payload that very many pages have is split by the adaptive join.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("target_uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"payload_digest": _base32(F.sha1("payload")), "payload_length": F.octet_length("payload").cast("long")})
    repeated = rows.groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(repeated, "payload_digest", "left")
    again = (F.col("payload_length") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), urn("page_id").alias("record_id"), "target_uri", "payload_digest", "payload_length",
        F.when(again, urn("first_id")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))


def page_number(column: str) -> Column:
    return F.regexp_extract(F.col(column), r"^urn:page:(-?\d+)$", 1).try_cast("long")
