"""Archives: standard readers, offsets, revisits, streams of several members, cut files."""

import gzip
import io
import zlib

import pytest
from pyspark.sql import types as T

from tidemark.llm import warc

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("digest", T.StringType()),
    ]
)


def page(i, html, url="http://example.com/ä b"):
    return (i, url, html, "own column")


def test_round_trip(spark):
    big, other = "é" * 500, "x" * 1200
    rows = [page(1, big), page(5, big), page(3, big), page(2, "short"), page(4, "short"), page(6, None), page(7, "")]
    rows += [page(8, other, None), page(8, other, None), page(9, "a" * 999), page(10, "a" * 999), page(11, "\r\n\r\nWARC/1.1\r\n" * 100)]
    rows += [page(None, big), page(None, "y" * 2000), page(None, "y" * 2000), page(12, "z" * 400_000)]
    out = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA), archive_bytes=3000).collect()
    assert len(out) == len(rows)
    kinds = sorted(((r.page_id or -1), r.payload_bytes, r.record_type, r.refers_to or 0) for r in out)
    revisits = [k for k in kinds if k[2] == "revisit"]
    assert revisits == [(-1, 1000, "revisit", 5), (1, 1000, "revisit", 5), (3, 1000, "revisit", 5)]
    import hashlib

    want = sorted(hashlib.sha1((h or "").encode()).hexdigest() for _, _, h, _ in rows)
    assert sorted(r.payload_digest for r in out) == want
    assert sum(r.payload_bytes for r in out) == sum(len((h or "").encode()) for _, _, h, _ in rows)


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_normalised_members(spark, tmp_path):
    records = [warc.record(i, "http://e.org", b"p" * i * 50, "00" * 20, None) for i in range(40)]
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (raw / "two.warc.gz").write_bytes(gzip.compress(b"".join(records[:7])) + gzip.compress(b"".join(records[7:])))
    counts = warc.normalise(spark, f"file://{raw}", f"file://{tmp_path}/out").collect()
    assert sorted(r.records for r in counts) == [40, 40]
    for name in ("one", "two"):
        data = (tmp_path / "out" / f"{name}.warc.gz").read_bytes()
        assert gzip.decompress(data) == b"".join(records)
        for want, line in zip(records, (tmp_path / "out" / f"{name}.warc.gz.idx").read_text().splitlines()):
            offset, length = map(int, line.split("\t")[:2])
            assert zlib.decompress(data[offset : offset + length], 31) == want


def test_cut_archives():
    whole = gzip.compress(warc.record(1, None, b"x" * 5000, "00" * 20, None))
    assert len(list(warc.split_records(warc.inflate(io.BytesIO(whole))))) == 1
    assert list(warc.split_records(warc.inflate(io.BytesIO(b"")))) == []
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflate(io.BytesIO(whole[:-20]))))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([warc.record(1, None, b"x" * 50, "00" * 20, None)[:-30]])))
