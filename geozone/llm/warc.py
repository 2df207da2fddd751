"""WARC archives: a writer of one gzip member per record, and a splittable reader of byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geozone.llm.common import shuffle_partitions, slices
from geozone.session import scratch_path

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
# gzip header flags: a member that goes on with the record before it carries the extra field "CN".
FIRST_MEMBER = MAGIC + b"\x00\x00\x00\x00\x00\x00\xff"
LATER_MEMBER = MAGIC + b"\x04\x00\x00\x00\x00\x00\xff\x04\x00CN\x00\x00"
# Uncompressed bytes of a member at most; below 2 ** 24, so that a member ends with a zero byte.
MEMBER_BYTES = 8 << 20
# Bytes of a file that one task scans, and bytes read at a time.
RANGE_BYTES = 4 << 20
READ_BYTES = 256 << 10
# Tasks that read ranges, for each partition of a shuffle.
RANGE_TASKS = 16


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as archives have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ------------------------------------------------------------------------------------------------


def member(raw: bytes, later: bool, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    return (LATER_MEMBER if later else FIRST_MEMBER) + body + zlib.crc32(raw).to_bytes(4, "little") + len(raw).to_bytes(4, "little")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>")]
    fields += [("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): of equal payloads of at least `least_bytes`, those whose page_id is not
    the largest are revisits of that one. Payloads are equal if their SHA-256 is."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    long = F.octet_length("payload") >= least_bytes
    last = rows.filter(long).groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = last.filter(F.col("n") > 1).select("sha", "last")
    met = rows.join(shared, "sha", "left").withColumn("revisit", long & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")))
    return met.select("page_id", "url", "payload", F.when(F.col("revisit"), F.col("last")).alias("refers_to"), F.coalesce("revisit", F.lit(False)).alias("revisit"))


def write_archives(records: DataFrame, path: str, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes (page_id, url, payload, refers_to, revisit) as WARC files, one gzip member per record (a record of more than
    MEMBER_BYTES has several).

    Spark's text writer does the writing, so any store that Spark knows will do and repeated or lost tasks leave nothing behind.
    It puts a separator behind each row; a member's last byte is zero (the top byte of its length), so members are handed
    over without it and the separator is that byte.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            out = []
            for row in batch.to_pylist():
                raw = record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"], date)
                parts = [raw[at : at + MEMBER_BYTES] for at in range(0, len(raw), MEMBER_BYTES)]
                out += [member(part, k > 0, level)[:-1] for k, part in enumerate(parts)]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    members = records.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", "\x00").text(path)


# --- reading ------------------------------------------------------------------------------------------------


def _open(path: str):
    from pyarrow import fs

    uri = re.sub(r"^(\w+):/(?!/)", r"\1:///", path)
    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)


class Bytes:
    """A file's bytes from an offset on, read piece by piece; what is behind is let go, and read again if asked for."""

    def __init__(self, file, size: int, at: int):
        self.file, self.size, self.base, self.held = file, size, at, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes at an offset."""
        end = min(at + n, self.size)
        if at < self.base:
            self.held, self.base = b"", at
        if at > self.base:
            self.held, self.base = self.held[at - self.base :], at
        if end > self.base + len(self.held):
            start = self.base + len(self.held)
            more = max(end - start, min(READ_BYTES, self.size - start))
            self.held += self.file.read_at(more, start)
        return self.held[: end - at]


class Member:
    """A gzip member, decoded step by step; `end` is where it stopped."""

    def __init__(self, source: Bytes, at: int):
        self.source, self.at = source, at
        self.packer = zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        """About n decoded bytes; none at the end."""
        out = b""
        while not self.packer.eof and len(out) < n:
            raw = self.packer.unconsumed_tail or self.source.get(self.at, READ_BYTES)
            if not raw:
                raise zlib.error("the file ends inside a member")
            if not self.packer.unconsumed_tail:
                self.at += len(raw)
            out += self.packer.decompress(raw, n - len(out))
        return out

    @property
    def end(self) -> int:
        return self.at - len(self.packer.unused_data)


def header_fields(head: bytes) -> dict[str, str] | None:
    """Names in lower case; None if these are not a record's header lines."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdigit() else None


def _record_at(source: Bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Fields, block and end of the record that starts at an offset, None if none does."""
    if not source.get(at, 4).startswith(MAGIC) or source.get(at, 4)[3:4] == LATER_MEMBER[3:4]:
        return None
    part = Member(source, at)
    try:
        data = b""
        while b"\r\n\r\n" not in data:
            if len(data) >= 5 and not data.startswith(b"WARC/"):
                return None
            more = part.read(max(4096, len(data)))
            if not more:
                if source.get(part.end, 4) != LATER_MEMBER[:4]:
                    return None
                part = Member(source, part.end)  # the header lines go on in the next member
            data += more
        head, _, block = data.partition(b"\r\n\r\n")
        fields = header_fields(head)
        if fields is None:
            return None
        size, parts = int(fields["content-length"]), [block]
        got = len(block)
        while got < size + 4:
            more = part.read(1 << 20)
            if not more:
                if got >= size:
                    break
                part = Member(source, part.end)  # the record goes on in the next member
                continue
            parts.append(more)
            got += len(more)
        while part.read(1 << 20):
            pass
        return fields, b"".join(parts)[:size], part.end
    except zlib.error:
        return None


def records_in(source: Bytes, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records that start in [start, end). A candidate is any gzip magic; it counts if it decodes to header lines, and what
    stands inside a record is skipped. A record may end beyond the range."""
    at = start
    while at < end:
        window = source.get(at, READ_BYTES)
        found = window.find(MAGIC)
        if found < 0:
            if len(window) < READ_BYTES:
                return
            at += len(window) - len(MAGIC) + 1
            continue
        at += found
        if at >= end:
            return
        got = _record_at(source, at)
        if got is None:
            at += 1
            continue
        yield at, got[0], got[1]
        at = got[2]


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP fields and payload of a record's block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {n.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for n, _, v in lines}, payload


RECORD = "file string, at bigint, record_type string, record_id string, url string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of all files below `path`: where each starts, its type, ids, url and payload.

    Files are cut into ranges of `range_bytes`; a task reads its range and what its last record needs beyond it, so one large
    file is read by many tasks, and each record by the task in whose range it starts. `payload_bytes` and `payload_digest`
    are those of the full payload: taken from the payload where the record has it, which must agree with the record's
    header, and from the headers of a revisit. Without `payloads` the payload itself is left out (null). The files are listed once ahead, to count
    the ranges; each has a task of its own, up to RANGE_TASKS times the partitions of a shuffle.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ranges = files.withColumn("start", F.explode(F.expr(f"sequence(0L, length, {range_bytes}L)"))).filter("start < length")
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    held: list[tuple] = []
                    size = 0
                    source = Bytes(file, row["length"], row["start"])
                    for at, fields, block in records_in(source, row["start"], min(row["start"] + range_bytes, row["length"])):
                        http, payload = payload_of(block)
                        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        kind = fields.get("warc-type", "")
                        if kind == "revisit":
                            n, payload = int(http.get("content-length", 0)), None
                        else:
                            n = len(payload)
                            if stated != digest(payload):
                                raise ValueError(f"{row['path']} at {at}: the payload does not have the digest of its header")
                        strip = lambda name: fields[name].strip("<>") if name in fields else None  # noqa: E731, B023
                        held.append(
                            (row["path"], at, kind, strip("warc-record-id"), fields.get("warc-target-uri"), strip("warc-refers-to"), n, stated, payload if payloads else None)
                        )
                        size += n if payloads else 0
                        if size > 4 << 20 or len(held) > 5000:
                            yield _rows(held, names)
                            held, size = [], 0
                    if held:
                        yield _rows(held, names)

    # Ranges are short rows that stand for much work: without a number of partitions all of them would be put into one.
    n = max(1, min(ranges.count(), RANGE_TASKS * shuffle_partitions(spark)))
    return ranges.repartition(n).mapInArrow(run, RECORD)


def _rows(held: list[tuple], names: list[str]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = [text, number, text, text, text, text, number, text, pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


# --- operator -----------------------------------------------------------------------------------------------


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes `pages` (page_id, url, html; other columns are not read) as archives to `path`, by default a new folder in the
    shared one, and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    A null html is an empty payload, a null url an absent field; a null page_id is never the one referred to unless no row with
    that payload has an id, and then nothing refers to it. Rows with the same page_id and payload are records of the same type.
    An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(with_revisits(pages, least_bytes), path)
    found = read_archives(spark, path, payloads=False)
    number = lambda c: F.nullif(F.substring(c, len(ID) + 1, 30), F.lit("")).cast("bigint")
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
