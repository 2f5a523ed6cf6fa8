import hashlib

import pytest

from tessera.llm import warc
from tessera.session import scratch_path

LONG = "<p>" + "é" * 200
ROWS = [(5, "http://a/1", LONG), (3, "http://a/2", LONG), (9, None, LONG), (1, "http://b/\r\n\r\nWARC/1.1", "short"), (2, "", "short"),
        (4, "http://c", None), (6, "http://d", ""), (7, "http://e", "x" * 99), (8, "http://e", "x" * 99), (10, "u", "x" * 100), (11, "u", "x" * 100),
        (None, "n", "y" * 300), (None, "n2", "y" * 300), (None, "n3", LONG), (12, "w", "WARC/1.1\r\n\r\nWARC-Type: response\r\n" * 20),
        (13, "w", "z" * 100_000), (3, "http://a/2", LONG)]


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as first", "'x' as payload", "3 as size")
    warc.write_archive(spark, pages.repartition(4), path)
    return path


def test_records(spark, archive):
    first = {}
    for k, _, h in ROWS:
        b = (h or "").encode()
        if k is not None and len(b) >= 100:
            first[b] = min(k, first.get(b, k))
    want = []
    for k, _, h in ROWS:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != k
        want.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    got = warc.verified_records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_each_payload_is_stored_once(spark, archive):
    stored = [bytes(r.payload) for r in warc.read_payloads(spark, archive).collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h in ROWS})


def test_reconstructed_records_are_exact(spark, archive):
    rows = warc.reconstruct(spark, archive).collect()
    assert sorted(bytes(r.payload) for r in rows) == sorted((h or "").encode() for _, _, h in ROWS)
    for r in rows:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.decode() == r.header and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        assert rest == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n" and len(rest) == size + 4


def test_exported_files_are_warc(spark, archive):
    target = scratch_path(spark, "warc-export")
    warc.export(spark, archive, target)
    found = []
    for r in spark.read.format("binaryFile").load(target).collect():
        rest = bytes(r.content)
        while rest:
            head, _, rest = rest.partition(b"\r\n\r\n")
            size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
            assert rest[size:size + 4] == b"\r\n\r\n"
            found.append((head, rest[:size]))
            rest = rest[size + 4:]
    want = [tuple(bytes(r.record)[:-4].split(b"\r\n\r\n", 1)) for r in warc.reconstruct(spark, archive).collect()]
    assert sorted(found) == sorted(want)


def test_query_measures_the_rebuilt_payloads(spark, monkeypatch):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {r.page_id: r.payload_bytes for r in QUERIES["op3_warc_archive"](spark, sf).collect()}
    rebuilt = warc.reconstruct
    monkeypatch.setattr(warc, "reconstruct", lambda *a: rebuilt(*a).selectExpr("*  except (payload)", "concat(payload, X'00') as payload"))
    got = {r.page_id: r.payload_bytes for r in QUERIES["op3_warc_archive"](spark, sf).collect()}
    assert got == {k: n + 1 for k, n in want.items()}


def test_urls_cannot_break_headers(spark, archive):
    urls = {r.page_id: r.url for r in warc.read_headers(spark, archive).collect()}
    assert urls[1] == "http://b/%0D%0A%0D%0AWARC/1.1" and urls[9] is None


def test_damaged_payload_is_an_error(spark):
    path = scratch_path(spark, "warc-damaged")
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "digest string, payload binary").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, path).collect()


def test_empty_table(spark):
    path = scratch_path(spark, "warc-empty")
    warc.write_archive(spark, spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.verified_records(spark, path).count() == 0
