import gzip
import hashlib
import io
import random
from base64 import b32encode

import pytest

from tallyspark.llm.queries.warc_query import op5_warc_round_trip
from tallyspark.llm.shared_files import new_folder, write_file
from tallyspark.llm.warc import MAGIC, archive_pages, http_block, read_archives, read_range, record_bytes


class Buffer(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def _archive(n):
    parts, starts, at = [], [], 0
    for i in range(n):
        block = http_block((b"payload %d " % i) * (i * 7 % 50), True)
        parts.append(record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>")], block))
        starts.append(at)
        at += len(parts[-1])
    return b"".join(parts), starts


@pytest.mark.parametrize("cut", [1, 17, 100, 1000, 10**6])
def test_each_record_is_read_once_wherever_the_ranges_lie(cut):
    data, starts = _archive(60)
    got = [r for a in range(0, len(data), cut) for r in read_range(Buffer(data), len(data), a, min(a + cut, len(data)))]
    assert [r.start for r in got] == starts and [r.fields["warc-record-id"] for r in got] == [f"<urn:page:{i}>" for i in range(60)]


def test_false_magic_damage_and_foreign_members_are_passed_over():
    data, _ = _archive(3)
    other = gzip.compress(b"not an archive")
    junk = b"\x00" + MAGIC + b"\x00" * 30 + other
    cut_off = data[: len(data) // 2]
    whole = junk + data + junk + data + cut_off
    assert len(list(read_range(Buffer(whole), len(whole), 0, len(whole)))) >= 7 - 1
    broken = bytearray(data)
    broken[15] ^= 0xFF
    assert len(list(read_range(Buffer(bytes(broken)), len(broken), 0, len(broken)))) == 2


def test_archives_on_disk(spark):
    folder = new_folder(spark, "warc")
    data, _ = _archive(200)
    files = spark.createDataFrame([(f"{folder}/a.gz", write_file(folder, "a.gz", [data])), (f"{folder}/b.gz", write_file(folder, "b.gz", []))], "file string, size long")
    assert read_archives(files, "id string, n long", lambda r: (r.fields["warc-record-id"], len(r.block)), block=777).distinct().count() == 200


def test_odd_pages(spark):
    long = "<p>" + "x y " * 400_000
    rows = [(1, "u\r\nX: y", "<p>ä</p>", 1), (2, None, "<p>ä</p>", 1), (2, "v", "<p>ä</p>", 1), (None, "w", "<p>ä</p>", 1), (3, "z", None, 1), (4, "z", "", 1), (5, "l", long, 1), (None, "n", "only null", 1)]
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, top int"), block=500).collect()), key=str)
    sha = lambda t: b32encode(hashlib.sha1(t.encode()).digest()).decode()
    a, e, n = sha("<p>ä</p>"), sha(""), sha("only null")
    assert got == sorted([(1, "revisit", 2, 9, a), (2, "response", None, 9, a), (2, "response", None, 9, a), (None, "revisit", 2, 9, a), (3, "revisit", 4, 0, e), (4, "response", None, 0, e), (5, "response", None, len(long), sha(long)), (None, "response", None, 9, n)], key=str)
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_on_the_smallest_tables(spark):
    assert op5_warc_round_trip(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_a_url_of_any_length_is_read_back(spark):
    rng = random.Random(3)
    rows = [(i, "data:" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)), f"page {i}") for i, n in enumerate((10, 70_000, 140_000, 1_500_000))] + [(9, "data:" + "a" * 3_000_000, "page 9")]
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()) == rows


@pytest.mark.parametrize("cut", [100, 1000, 10**6])
def test_a_record_that_was_written_and_cannot_be_read_is_an_error(cut):
    data, starts = _archive(40)
    read = lambda d, size: [r for a in range(0, size, cut) for r in read_range(Buffer(d), size, a, min(a + cut, size), True)]
    assert [r.start for r in read(data, len(data))] == starts
    for at in (0, 17, 39):
        end = [*starts, len(data)][at + 1]
        for place in (starts[at], starts[at] + 15, (starts[at] + end) // 2, end - 6):
            broken = bytearray(data)
            broken[place] ^= 0xFF
            with pytest.raises(ValueError, match="no whole record"):
                read(bytes(broken), len(data))
        with pytest.raises(ValueError, match="no whole record"):
            read(data[: starts[at]], len(data))
