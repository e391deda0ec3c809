import gzip
import hashlib
import io

from pyspark.sql import functions as F

from gaugemill.llm import queries, warc

SCHEMA = "page_id long, url string, html string, headers string"


def test_round_trip_and_revisits(spark, tmp_path):
    long, other = "é<p>" * 400, "x" * 999
    rows = [(1, "http://a/1\r\nX: y", long, "h"), (2, None, long, "h"), (9, "u", long, "h"), (3, "u", other, "h"), (4, "u", other, "h"), (5, "u", None, "h"), (6, "u", "", "h"), (None, "u", long, "h"), (9, "u", long, "h"), (11, "u", "\r\n\r\nHTTP/1.1" + "z" * 300_000, "h")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op7_warc_source(spark, str(tmp_path)).collect()
    best, want = {long: 9}, []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        again = html in best and i != best[html]
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best[html] if again else None))
    assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)


def test_filters_are_pushed_down_and_payloads_skipped(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/x", f"page {i % 40} " * 200, "h") for i in range(200)]
    warc.archive(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w")
    df = warc.read(spark, f"file://{tmp_path}/w")
    assert df.where("record_type = 'revisit' and target_uri like 'http://h1%'").count() == sum(i % 3 == 1 and i < 160 for i in range(200))
    assert df.where("record_type = 'response'").select(F.sum(F.length("payload"))).first()[0] == sum(len(r[2]) for r in rows[160:])
    assert df.where("record_id in ('urn:page:3', 'urn:page:190')").count() == 2 and df.where("refers_to is null").count() == 40
    assert df.where("headers['warc-target-uri'] = 'http://h2/x'").count() == 66
    assert warc.read(spark, f"file://{tmp_path}/w", payload=False).where("payload is not null").count() == 0
    reader = warc.WarcReader(f"file://{tmp_path}/w", True)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")])) == [warc.EqualTo(("payload",), b"")]
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 160


def test_files_of_other_writers(tmp_path):
    head, body = warc.record({"record_type": "response", "record_id": "urn:page:1", "target_uri": "u", "payload_digest": None, "refers_to": None, "payload_length": None, "headers": {"X-A": "b"}, "payload": b"abc\r\n\r\nd"})
    raw = head + body + b"\r\n\r\n"
    for data in (raw * 3, gzip.compress(raw) * 3, gzip.compress(raw, mtime=0) + warc.member(head, body) * 2):
        got = list(warc._records(io.BytesIO(data), lambda f: True, True))
        assert [(f["record_id"], f["headers"]["x-a"], p) for f, p in got] == [("urn:page:1", "b", b"abc\r\n\r\nd")] * 3
        assert [p for _, p in warc._records(io.BytesIO(data), lambda f: True, False)] == [None] * 3
    assert gzip.decompress(warc.member(head, body)) == raw


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op7_warc_source(spark, str(tmp_path)).count() == 0
