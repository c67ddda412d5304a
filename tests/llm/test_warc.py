import base64
import gzip
import hashlib

import pyspark.sql.functions as F
import pytest

from crewmetrics.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"
ROWS = [
    (5, "http://a.example/x", "<p>same</p>", "extra"),
    (2, "http://b.example/\r\nInjected: 1", "<p>same</p>", None),
    (9, None, "<p>same</p>", None),
    (1, "http://a.example/y", "<p>é 世界</p>", None),
    (3, "http://a.example/z", None, None),
    (4, "http://a.example/z", "", None),
    (None, "http://a.example/n", "<p>same</p>", None),
    (6, "http://a.example/w", "WARC/1.1\r\n\r\n" * 50_000, None),
    (7, "http://a.example/w", "x\r\n\r\ny", None),
    (7, "http://a.example/w", "x\r\n\r\ny", None),
]


def expected(rows, min_bytes=0):
    first = {}
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        if page_id is not None and len(body) >= min_bytes:
            first[body] = min(page_id, first.get(body, page_id))
    out = []
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        of = first.get(body)
        revisit = of is not None and of != page_id
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", of if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 1, 10_000])
def test_round_trip(spark, min_bytes):
    got = warc.round_trip(spark.createDataFrame(ROWS, SCHEMA), min_bytes).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS, min_bytes)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("compress", ["true", "false"])
def test_payloads_and_pushed_filters(spark, compress, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/a"
    rows = [("response", "urn:1", None, "http://a", "d", warc.digest_of(b"body\r\n\r\n1"), 9, b"body\r\n\r\n1"),
            ("revisit", "urn:2", "urn:1", None, "d", warc.digest_of(b"body\r\n\r\n1"), 9, None),
            ("response", "urn:3", None, "http://b", "d", warc.digest_of(b"z" * 200_000), 200_000, b"z" * 200_000)]
    df = spark.createDataFrame(rows, warc.SCHEMA).coalesce(1)
    df.write.format("warc").option("compress", compress).mode("append").save(path)
    back = warc.read_archives(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    wanted = back.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://b"))
    assert [r.record_id for r in wanted.collect()] == ["urn:3"]
    assert "StringStartsWith" not in wanted._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[0]
    assert [r.record_id for r in back.where(~F.col("record_type").isin("response", "x")).collect()] == ["urn:2"]
    assert [r.record_id for r in back.where("refers_to is not null").collect()] == ["urn:2"]
    skipped = warc.read_archives(spark, path, "skip").collect()
    assert sorted((r.payload_bytes, r.payload) for r in skipped) == [(9, None), (9, None), (200_000, None)]


def test_foreign_archive_without_lengths(spark, tmp_path):
    records = [
        warc.record_bytes(dict(record_type=t, record_id=f"urn:{i}", refers_to=None, target_uri="http://x", date="d",
                               payload_digest=warc.digest_of(b"p" * n), payload_bytes=n, payload=b"p" * n))
        for i, (t, n) in enumerate([("response", 3), ("response", 300_000), ("response", 0)])
    ]
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [other, *records]))
    (tmp_path / "y.warc").write_bytes(b"".join([other, *records]))
    got = warc.read_archives(spark, f"file://{tmp_path}", "verify").collect()
    assert sorted((r.record_type, r.payload_bytes) for r in got) == sorted(
        2 * [("warcinfo", 4), ("response", 3), ("response", 300_000), ("response", 0)]
    )


def test_damaged_payload_is_found(spark, tmp_path):
    record = warc.record_bytes(dict(record_type="response", record_id="urn:1", refers_to=None, target_uri=None, date="d",
                                    payload_digest=warc.digest_of(b"abc"), payload_bytes=3, payload=b"abd"))
    (tmp_path / "x.warc").write_bytes(record)
    with pytest.raises(Exception, match="another payload"):
        warc.read_archives(spark, f"file://{tmp_path}", "verify").collect()


def test_base32(spark):
    rows = [(hashlib.sha1(bytes([i])).hexdigest(), base64.b32encode(hashlib.sha1(bytes([i])).digest()).decode()) for i in range(64)]
    got = spark.createDataFrame(rows, "h string, b string").select(warc.base32(F.col("h")), "b").collect()
    assert all(a == b for a, b in got)

