"""WARC archives: one gzip member a record, and a reader that splits archives at any byte.

The reader cuts each archive into byte ranges. A task looks for the gzip magic in its range, tries each
place by inflating the start of a member and decoding a WARC header from it, and owns the records that
start inside its range, however far they reach beyond its end. No index and no record boundaries are
needed, and records are neither lost nor read twice.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.llm.shared_files import new_folder, open_fs, ranges, write_file
from tallyspark.runtime import materialize

#: Bytes of a range, and bytes read at a time.
RANGE, STEP = 1 << 20, 1 << 18
#: A member: gzip magic and the deflate method.
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """A record as read: its header fields by lower-case name, its block, and where its member starts and ends."""

    fields: dict[str, str]
    block: bytes
    start: int
    end: int


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value may hold no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record as one gzip member; the same input gives the same bytes."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8") + block + b"\r\n\r\n") + z.flush()


def http_block(payload: bytes, with_payload: bool) -> bytes:
    """An HTTP response; a revisit holds its headers alone, which keep the length of the payload."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if with_payload else b"")


def decode_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of the WARC header that ``data`` starts with, and where the block begins; None if it is none."""
    if not data.startswith(b"WARC/") or (end := data.find(b"\r\n\r\n")) < 0:
        return None
    fields: dict[str, str] = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


class _Window:
    """A file read through one buffer that moves forward, so that a range is read once."""

    def __init__(self, file, size: int):  # noqa: ANN001
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.data)):
            self.at = start
            self.data = self.file.read_at(min(max(n, STEP), self.size - start), start) if n else b""
        return self.data[start - self.at : start - self.at + n]


def _header_at(w: _Window, start: int) -> bool:
    """Whether a member at ``start`` inflates to a WARC header, however long it is."""
    z, got, at = zlib.decompressobj(31), bytearray(), start
    while at < w.size and not z.eof and (part := w.get(at, 4096)):
        before = len(got)
        try:
            got += z.decompress(part)
        except zlib.error:
            return False
        if len(got) >= 5 and not got.startswith(b"WARC/"):
            return False
        if got.find(b"\r\n\r\n", max(0, before - 3)) >= 0:
            break
        at += len(part)
    return decode_header(bytes(got)) is not None


def _member(w: _Window, start: int) -> tuple[bytes, int] | None:
    """The content of the member at ``start`` and where it ends; None if it is damaged or cut off."""
    z, parts, at = zlib.decompressobj(31), [], start
    while at < w.size and (part := w.get(at, 65536)):
        try:
            parts.append(z.decompress(part))
        except zlib.error:
            return None
        at += len(part)
        if z.eof:  # the checksum was right
            return b"".join(parts), at - len(z.unused_data)
    return None


def read_range(file, size: int, start: int, stop: int, whole: bool = False) -> Iterator[Record]:  # noqa: ANN001
    """The records of an archive whose members start in [start, stop).

    Damaged members are passed over. With ``whole`` the archive has to be nothing but records, as
    ``write_archives`` leaves it, and a ValueError is raised where one is missing: the first starts at
    byte 0, and each record, the last of the range too, is followed by another or by the end. So if no range raises, the
    records read fill all ``size`` bytes written and none is lost.
    """
    w, at, due = _Window(file, size), start, whole and start == 0  # due: a record has to start at ``at``

    def missing() -> ValueError:
        return ValueError(f"the archive of {size} bytes has no whole record at byte {at}")

    while at < stop:
        here = w.get(at, len(MAGIC))
        if due and here != MAGIC:
            raise missing()
        if here != MAGIC:  # not at the start of a member: search on
            here = w.get(at, STEP)
        if whole and len(here) < min(STEP if here[: len(MAGIC)] != MAGIC else len(MAGIC), size - at):  # the file is shorter than it was
            raise missing()
        found = here.find(MAGIC)
        if found < 0:
            if at + len(here) >= size or len(here) < len(MAGIC):
                return
            at += len(here) - len(MAGIC) + 1  # the magic may lie across two reads
            continue
        at += found
        if at >= stop:
            return
        headed = _header_at(w, at)
        if headed and (got := _member(w, at)):
            content, end = got
            if head := decode_header(content):
                fields, begin = head
                yield Record(fields, content[begin : begin + int(fields["content-length"])], at, end)
            at, due = end, whole  # the next member starts here, if it does
        elif due or whole and headed:
            raise missing()
        else:
            at += 1
    if due and at < size and not (w.get(at, len(MAGIC)) == MAGIC and _header_at(w, at)):
        raise missing()


def read_archives(files: DataFrame, schema: str, row: Callable[[Record], tuple], block: int = RANGE, whole: bool = False) -> DataFrame:
    """A row for each record of the archives in ``files`` (columns file, size): what ``row`` makes of it.

    Archives are cut at every ``block`` bytes; a task holds one record and one read at a time. ``whole``
    raises an error where a record is damaged, cut off or missing (see ``read_range``). An empty table of files and an empty file give no rows.
    """
    names = StructType.fromDDL(schema).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                fs, path = open_fs(r.file)
                with fs.open_input_file(path) as file:
                    out, held = [], 0
                    for record in read_range(file, r.size, r.start, r.stop, whole):
                        out.append(row(record))
                        held += len(record.block)
                        if held > 1 << 24:
                            yield pd.DataFrame(out, columns=names, dtype=object)
                            out, held = [], 0
                    if out:
                        yield pd.DataFrame(out, columns=names, dtype=object)

    return ranges(files, block).mapInPandas(run, schema)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (uid, url, payload, kind, refers) as archives, one a task; returns ``file, size``, one row an archive.

    A task that is repeated writes the same records again under the same name.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def records() -> Iterator[bytes]:
            for f in frames:
                for p in f.itertuples(index=False):
                    payload = bytes(p.payload)
                    fields = [("WARC-Type", p.kind), ("WARC-Record-ID", f"<urn:page:{p.uid}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", p.url or ""), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("Content-Type", "application/http;msgtype=response")]
                    if p.kind == "revisit":
                        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{p.refers}>")]
                    yield record_bytes(fields, http_block(payload, p.kind == "response"))

        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        size = write_file(folder, name, records())
        yield pd.DataFrame({"file": [f"{folder}/{name}"], "size": [size]})

    return pages.select("uid", "url", "payload", "kind", "refers").mapInPandas(run, "file string, size long")


def revisits(pages: DataFrame, id_col: str, payload: Column) -> DataFrame:
    """``row, payload, kind, refers``: of pages with equal payloads the one with the largest id is the response, the others revisit it.

    The largest id of each digest is found by a pre-aggregated maximum and joined back, so copies by
    the thousand are no hot group. Null ids are smallest; rows that share the largest id and the payload are
    all responses, and so are all rows of a payload that has null ids only.
    """
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    top = d.groupBy("digest").agg(F.max(F.col(f"row.`{id_col}`")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").withColumnRenamed("digest", "same")
    me = F.col(f"row.`{id_col}`")
    first = F.col("top").isNull() | F.coalesce(me == F.col("top"), F.lit(False))
    return d.join(materialize(top, "copies"), F.col("digest") == F.col("same"), "left").select("row", "payload", F.when(first, "response").otherwise("revisit").alias("kind"), F.when(~first, F.col("top")).alias("refers"))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block: int = RANGE) -> DataFrame:
    """Write a record for each page into the shared folder and read the archives back: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    The payload is the html in UTF-8, a null one is empty; ``payload`` is null for revisits. Everything
    returned comes from the archives; the digest of a response is that of the payload read, and has
    to equal the header's. A null id is written as ``null`` and read back as null; a null url is
    read back as an empty one. A url may have any length, and a record that was written and cannot be read is an error. Repeated rows are records of their own. Other columns are not written.
    An empty table gives an empty result.
    """
    spark = pages.sparkSession
    src = revisits(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")), "id", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    rows = src.select(text(F.col("row.id")).alias("uid"), F.col("row.url").alias("url"), "payload", "kind", text(F.col("refers")).alias("refers"))
    files = materialize(write_archives(rows, new_folder(spark, "warc")), "archives")

    def row(r: Record) -> tuple:
        number = lambda v: None if v == "null" else int(v)
        name = lambda field: number(r.fields[field][len("<urn:page:") : -1])
        head, _, payload = r.block.partition(b"\r\n\r\n")
        stated = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        digest = r.fields["warc-payload-digest"].removeprefix("sha1:")
        response = r.fields["warc-type"] == "response"
        if response and (len(payload) != stated or sha1_base32(payload) != digest):
            raise ValueError(f"the payload of {r.fields['warc-record-id']} is damaged")
        return name("warc-record-id"), r.fields.get("warc-target-uri", ""), r.fields["warc-type"], None if response else name("warc-refers-to"), stated, digest, payload if response else None

    return read_archives(files, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary", row, block, whole=True)
