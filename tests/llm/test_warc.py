import base64
import glob
import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from geozone.llm import warc as W


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id bigint, url string, html string, payload string, sha int")


def sample():
    rng = np.random.default_rng(0)
    rows = [(k, f"http://e.org/{k}?q=é b", "".join(map(chr, rng.integers(32, 1200, rng.integers(0, 3000))))) for k in range(80)]
    rows += [(200, None, rows[3][2]), (150, "x", rows[3][2]), (201, "new\r\nline: x", rows[4][2]), (202, "", None), (203, "u", ""), (204, "u", None)]
    rows += [(300, "u", "big " * 600_000), (301, "u", "big " * 600_000), (None, "u", rows[3][2]), (None, "u", "only nulls"), (None, "u", "only nulls")]
    rows += [(400, "u", "twice"), (400, "u", "twice"), (401, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")]
    return rows


def brute(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = last.get(h or "")
        revisit = top is not None and i != top
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((str(i), len(raw), digest, "revisit" if revisit else "response", str(top if revisit else None)))
    return sorted(out)


def test_written_and_read_back(spark):
    got = W.archive(pages_of(spark, sample()).repartition(3)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(sample())
    assert W.archive(pages_of(spark, [])).collect() == []


@pytest.mark.parametrize("range_bytes", [37, 1000, 1 << 30])
def test_ranges_own_the_records_that_start_in_them(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(W, "MEMBER_BYTES", 1 << 16)
    monkeypatch.setattr(W, "READ_BYTES", 512)
    rows = [r for r in sample() if len(r[2] or "") < 5_000][:25] + [(500, "u", "long" * 40_000)]
    path = str(tmp_path / "archive")
    W.write_archives(W.with_revisits(pages_of(spark, rows).coalesce(1)), path)
    (file,) = glob.glob(f"{path}/part-*")
    whole = gzip.open(file).read()  # any reader of concatenated members takes the file
    assert whole.count(b"WARC-Record-ID:") == len(rows)
    raw = open(file, "rb").read()
    found = []
    for start in range(0, len(raw), range_bytes):
        source = W.Bytes(_At(raw), len(raw), start)
        found += [(at, W.payload_of(block)[1]) for at, _, block in W.records_in(source, start, min(start + range_bytes, len(raw)))]
    assert len(found) == len({at for at, _ in found}) == len(rows)
    assert sorted(p for _, p in found) == sorted((h or "").encode() for _, _, h in rows)


class _At(io.BytesIO):
    def __init__(self, raw):
        super().__init__(raw)

    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def test_payloads_urls_and_least_bytes(spark, tmp_path):
    rows = [(1, "http://a/ü", "hello wörld"), (2, "http://b", "hello wörld"), (3, None, "")]
    path = str(tmp_path / "small")
    W.write_archives(W.with_revisits(pages_of(spark, rows), least_bytes=100), path)
    got = {r.record_id: r for r in W.read_archives(spark, path).collect()}
    assert bytes(got["urn:page:1"].payload).decode() == "hello wörld" and got["urn:page:1"].record_type == "response"
    assert got["urn:page:1"].url == "http://a/%C3%BC" and got["urn:page:3"].url is None


def test_changed_payload_is_noticed(spark, tmp_path):
    raw = W.record(1, "u", b"payload", None, False, "2024-01-01T00:00:00Z").replace(b"payload\r\n", b"paYload\r\n")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "one.warc.gz").write_bytes(W.member(raw, False, 6))
    with pytest.raises(Exception, match="digest of its header"):
        W.read_archives(spark, str(tmp_path / "bad")).collect()


def test_foreign_archives(spark, tmp_path):
    """Ordinary gzip members with names and other headers, junk between records, and a file that is cut off."""
    raw = [W.record(k, "u", b"p" * 50 * k, None, False, "2024-01-01T00:00:00Z") for k in range(4)]
    body = b"junk\x1f\x8b\x08junk" + b"".join(gzip.compress(r) for r in raw) + gzip.compress(b"not a record") + gzip.compress(raw[1])[:40]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(body)
    got = W.read_archives(spark, str(tmp_path / "a"), range_bytes=64).select("payload_bytes", F.length("payload").alias("n")).collect()
    assert sorted((r.payload_bytes, r.n) for r in got) == [(50 * k, 50 * k) for k in range(4)]


def test_header_lines_of_any_length(spark):
    rng = np.random.default_rng(4)
    urls = ["http://a.example/" + "".join(map(str, rng.integers(0, 10, n))) for n in (10, 200_000, 900_000, 9_000_000, 20)]
    rows = [(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)]
    got = W.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(i, 8, "response") for i in range(5)]


def test_several_tasks_read(spark, tmp_path):
    """The records of one archive come from as many tasks as it has ranges with records, each record once."""
    path = str(tmp_path / "archive")
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    W.write_archives(W.with_revisits(pages.coalesce(1), 0), path)
    found = W.read_archives(spark, path, range_bytes=16 << 10).withColumn("task", F.spark_partition_id())
    assert found.count() == 400
    assert found.select("task").distinct().count() >= 4
