"""Legacy archive converter: ARC files in, WARC files out, as distributed file reads and text writes.

An ARC file starts with a version block; version 1 and 2 have different header
lines, and each record declares its length, which is what bounds its body. The
converter reads any such file, plain or gzip, in one member or one per record,
with either line end and with blanks in urls. It synthesises what WARC wants in
addition: record ids, ISO timestamps, types and SHA-1 digests; of HTTP responses
with equal payloads one is the response and the others revisit it. Records that
are no HTTP response (dns, ftp) become resources, the version block a warcinfo.

An index pass reads urls and digests only; what revisits what is a join on
digests. The second pass reads each archive with the revisits among its records
and writes the WARC records at once, so payloads are never shuffled while the
list of revisits is small enough to broadcast; else the compressed files are,
once.

Files are written by Spark's writer into the shared folder, gzip-compressed, one
per partition. A reader holds one compressed file and unpacks it record by record.

``write_arc`` makes archives of a pages table: the page id is the fragment of
each record's url, where ``read_warc`` finds it again.

Defined results: a null html is an empty payload; a null or empty url is written
as ``about:blank``; blanks in a url are percent-encoded; a row without a page id
comes back without one: it revisits the smallest id with an equal payload, or,
if no such row has an id, the first of them in the archives is the response; rows
that repeat a page id with an equal payload are all responses if that id is the
smallest; a very long page is one record, held by one task; an empty table gives
empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, ship

#: A group of equal payloads is dealt over so many parts where its records meet their response.
SALTS = 16
#: A list of at most so many revisits (about 200 bytes each) is broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of records that a task hands on at once.
BATCH_BYTES = 4 << 20
ARC_FIELDS = {
    # The header fields of the two ARC versions.
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_MARK = "#page-id="
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uuid(file: str, number: int) -> str:
    """The id of a converted record, from its archive's name and its number there."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file.rsplit("/", 1)[-1]}#{number}')}"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_date(page_id: int | None) -> str:
    """The 14 digits of a capture: pages carry no date, so one second per page from the start of 2000 on."""
    return datetime.fromtimestamp(946684800 + (page_id or 0) % 500_000_000, UTC).strftime("%Y%m%d%H%M%S")


def page_url(url: str | None, page_id: int | None) -> str:
    url = "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in url or "") or "about:blank"
    return f"{url}{PAGE_MARK}{'' if page_id is None else page_id}"


def page_of(url: str) -> tuple[str, int | None]:
    """The url as it was, and the page id; foreign urls have none."""
    plain, mark, number = url.rpartition(PAGE_MARK)
    if not mark or number and not re.fullmatch(r"-?\d+", number):
        return url, None
    return plain, int(number) if number else None


def arc_record(version: int, url: str | None, page_id: int | None, html: bytes) -> bytes:
    """One ARC record without the line end that parts it from the next. The body is the HTTP response as received."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
    head = [page_url(url, page_id), "0.0.0.0", capture_date(page_id), "text/html"]
    if version == 2:
        head += ["200", sha1_base32(html), "-", "0", "pages.arc"]
    return f"{' '.join(head)} {len(body)}\n".encode() + body


def version_block(version: int) -> bytes:
    body = f"{version} 0 eventloom\n{ARC_FIELDS[version]}\n".encode()
    head = ["filedesc://pages.arc", "0.0.0.0", "20000101000000", "text/plain"] + (["200", "-", "-", "0", "pages.arc"] if version == 2 else [])
    return f"{' '.join(head)} {len(body)}\n".encode() + body


def arc_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of one ARC file; the writer adds a line end after each. The version follows the first page."""
    version = None
    for b in batches:
        out = []
        for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if version is None:
                version = 1 + (page or 0) % 2
                out.append(version_block(version))
            out.append(arc_record(version, url, page, html or b""))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


class Unpacked:
    """The bytes of a file from front to back, unpacked in stretches if it is gzip, in one member or many."""

    def __init__(self, data: bytes, stretch: int = 1 << 20) -> None:
        self.data, self.at, self.stretch, self.used, self.ready = data, 0, stretch, 0, bytearray()
        self.unzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _next(self) -> bytes:
        """The next stretch; empty only at the end of the file."""
        while True:
            if self.unzip is None:
                part = self.data[self.at : self.at + self.stretch]
                self.at += len(part)
                return part
            if self.unzip.eof:
                self.at -= len(self.unzip.unused_data)
                self.unzip = zlib.decompressobj(31)
                if self.data[self.at : self.at + 2] != b"\x1f\x8b":  # the end, or padding
                    self.at = len(self.data)
            feed = self.unzip.unconsumed_tail or self.data[self.at : self.at + self.stretch]
            if not self.unzip.unconsumed_tail:
                self.at += len(feed)
            if not feed:
                return b""
            if part := self.unzip.decompress(feed, self.stretch):
                return part

    def more(self) -> bool:
        part = self._next()
        del self.ready[: self.used]
        self.used = 0
        self.ready += part
        return bool(part)

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the file."""
        while (i := self.ready.find(mark, self.used)) < 0:
            if not self.more():
                if self.ready[self.used :].strip():
                    raise ValueError("an archive ends inside a record's header")
                return None
        out = bytes(self.ready[self.used : i + len(mark)])
        self.used = i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) - self.used < n:
            if not self.more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.ready[self.used : self.used + n])
        self.used += n
        return out


def parsed_arc(data: bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """url, date, content type and body of each record, the version block first, by the declared fields and lengths."""
    file, fields = Unpacked(data), None
    while (line := file.until(b"\n")) is not None:
        if not line.strip():
            continue
        head = line.decode("utf-8", "replace").strip()
        if fields is None:
            if not head.startswith("filedesc://"):
                raise ValueError("an ARC file starts with its version block")
            body = file.take(int(head.rsplit(" ", 1)[1]))
            version, names, *_ = [*body.decode("utf-8", "replace").split("\n"), "", ""]
            fields = names.split()
            if not re.match(r"[12] ", version) or [x.lower() for x in fields] != ARC_FIELDS[int(version[0])].lower().split():
                raise ValueError("an ARC version that isn't known")
            yield head.split(" ")[0], head.split(" ")[2], "text/plain", body
            continue
        found = head.rsplit(" ", len(fields) - 1)  # blanks may stand in the url, which comes first
        if len(found) != len(fields):
            raise ValueError("an ARC header line has too few fields")
        yield found[0], found[2], found[3], file.take(int(found[-1]))


def parsed_http(body: bytes) -> tuple[bytes, bytes] | None:
    """Header and payload of an HTTP response as received; None for anything else."""
    if not body.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", body)
    cut = end.end() if end else len(body)
    return body[:cut], body[cut:]


def timestamp(date: str) -> str:
    """An ARC date, of 14 digits or fewer, in ISO form."""
    d = (digits := re.sub(r"\D", "", date)[:14]) + "00000101000000"[len(digits) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows gathered column by column; ``size`` of a row in bytes."""
    held, n = [[] for _ in schema], 0
    for row in rows:
        for column, value in zip(held, row, strict=True):
            column.append(value)
        n += size(row)
        if n >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema)
            held, n = [[] for _ in schema], 0
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema, strict=True)], schema=schema)


INDEX = "file string, number long, page long, url string, date string, digest string"


def arc_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place, page, url, date and payload digest of each HTTP response."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for number, (url, date, _, body) in enumerate(parsed_arc(data.as_buffer().to_pybytes())):
                    if http := parsed_http(body):
                        yield file, number, page_of(url)[1], url, date, sha1_base32(http[1])

    text, whole = pa.string(), pa.int64()
    return in_batches(rows(), pa.schema({"file": text, "number": whole, "page": whole, "url": text, "date": text, "digest": text}), lambda r: 200)


def warc_record(kind: str, record_id: str, date: str, content_type: str, block: bytes, more: list[str]) -> bytes:
    """One record up to and with the first of its two closing line ends."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {timestamp(date)}", *more, f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Type: {content_type}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n"


def warc_of(file: str, data: bytes, revisits: dict[int, dict]) -> Iterator[bytes]:
    """The WARC records of one archive; ``revisits``: by record number the response that it refers to."""
    for number, (url, date, content_type, body) in enumerate(parsed_arc(data)):
        record_id, http = record_uuid(file, number), parsed_http(body)
        target = [f"WARC-Target-URI: {url}"]
        if number == 0:
            origin = body.split(b"\n")[0].decode("utf-8", "replace").strip()
            fields = f"software: eventloom\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\ndescription: converted from ARC, version block {origin}\r\n"
            yield warc_record("warcinfo", record_id, date, "application/warc-fields", fields.encode(), [f"WARC-Filename: {url.removeprefix('filedesc://')}"])
        elif http is None:
            yield warc_record("resource", record_id, date, content_type, body, [*target, f"WARC-Payload-Digest: sha1:{sha1_base32(body)}"])
        else:
            header, payload = http
            target.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
            if first := revisits.get(number):
                target += [
                    f"WARC-Refers-To: <{record_uuid(first['file'], first['number'])}>", f"WARC-Refers-To-Target-URI: {first['url']}", f"WARC-Refers-To-Date: {timestamp(first['date'])}",
                    f"WARC-Profile: {REVISIT_PROFILE}", f"X-Payload-Length: {len(payload)}",
                ]
            yield warc_record("revisit" if first else "response", record_id, date, "application/http; msgtype=response", header if first else body, target)


def warc_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[bytes]]:
        for b in batches:
            for file, data, found in zip(b.column("file").to_pylist(), b.column("content"), b.column("revisits").to_pylist(), strict=True):
                for record in warc_of(file, data.as_buffer().to_pybytes(), {x["at"]: x for x in found or ()}):
                    yield (record,)

    return in_batches(rows(), pa.schema({"value": pa.binary()}), lambda r: len(r[0]))


def parsed_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by the declared length."""
    file = Unpacked(data)
    while (header := file.until(b"\r\n\r\n")) is not None:
        first, *lines = header[:-4].decode().lstrip("\r\n").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a WARC record starts with its version")
        head = {k: v.strip() for k, v in (x.split(":", 1) for x in lines)}
        block = file.take(int(head["Content-Length"]))
        if file.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is longer or shorter than declared")
        yield head, block


WARC_ROW = "page_id long, url string, record_id string, date string, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_to_record string"


def warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that stand for captures, checked against their digests."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for data in b.column("content"):
                for head, block in parsed_warc(data.as_buffer().to_pybytes()):
                    if sha1_base32(block) != head["WARC-Block-Digest"].removeprefix("sha1:"):
                        raise ValueError("a digest differs from the block that it stands for")
                    if (kind := head["WARC-Type"]) == "warcinfo":
                        continue
                    http, digest = parsed_http(block), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = http[1] if http else block
                    if kind != "revisit" and sha1_base32(payload) != digest:
                        raise ValueError("a digest differs from the payload that it stands for")
                    url, page = page_of(head["WARC-Target-URI"])
                    size = int(head["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    first = page_of(head["WARC-Refers-To-Target-URI"])[1] if kind == "revisit" else None
                    yield page, url, head["WARC-Record-ID"].strip("<>"), head["WARC-Date"], kind, digest, size, first, head.get("WARC-Refers-To", "").strip("<>") or None

    kinds = {"string": pa.string(), "long": pa.int64()}
    return in_batches(rows(), pa.schema({n: kinds[k] for n, k in (x.split() for x in WARC_ROW.split(", "))}), lambda r: 300)


def _written(records: DataFrame, path: str, line_end: str) -> None:
    # Fast compression: it is most of what a conversion costs.
    lines = records.select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", line_end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """ARC files of both versions."""
    ship(pages.sparkSession)
    d = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    _written(d.mapInArrow(arc_lines, "value binary"), path, "\n")


def files_of(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file`` and ``content`` of each archive."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), "content")


def revisits(index: DataFrame) -> DataFrame:
    """file and ``at`` of each record that revisits another, with place, url and date of that response."""
    order = F.struct(F.col("page").isNull().alias("none"), "page", "date", "file", "number", "url")
    groups = index.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = index.select("file", "number", "page", "digest", F.pmod(F.xxhash64("file", "number"), F.lit(SALTS)).cast("int").alias("salt"))
    same = F.coalesce(F.col("page") == F.col("first.page"), F.lit(False)) | ((F.col("file") == F.col("first.file")) & (F.col("number") == F.col("first.number")))
    return rows.join(groups, ["digest", "salt"]).filter(~same).select("file", F.struct(F.col("number").alias("at"), "first.file", "first.number", "first.url", "first.date").alias("x"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, shelf: Shelf, *, glob: str = "*") -> None:
    """WARC files of all ARC files below a path."""
    ship(spark)
    files = files_of(spark, arc_path, glob)
    index = shelf.stored(files.mapInArrow(arc_index, INDEX), "index")
    found = shelf.stored(revisits(index), "revisits")
    by_file = found.groupBy("file").agg(F.collect_list("x").alias("revisits"))
    if found.count() <= BROADCAST_ROWS:
        by_file = F.broadcast(by_file)
    _written(files.join(by_file, "file", "left").mapInArrow(warc_lines, "value binary"), warc_path, "\r\n")


def read_warc(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """One row per response, revisit or resource."""
    ship(spark)
    return files_of(spark, path, glob).mapInArrow(warc_rows, WARC_ROW)


def converted_pages(pages: DataFrame) -> DataFrame:
    """The whole way: pages to ARC files, ARC to WARC files, and the WARC records read back, lazily."""
    spark = pages.sparkSession
    shelf = Shelf(spark, "archives")
    arc, out = shelf.place("arc"), shelf.place("warc")
    write_arc(pages, arc)
    convert(spark, arc, out, shelf, glob="part-*")
    shelf.discard(arc)
    return read_warc(spark, out, glob="part-*")
