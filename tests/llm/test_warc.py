"""Archives written and read back, against a plain count in Python."""

import base64
import hashlib

from traceframe.llm import warc

ROWS = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (None, "http://n", "<p>x</p>"),
    (5, "http://a/5", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "http://a/6", "é" * 70000), (1, "http://a/1", "<p>x</p>"), (7, "a\r\nb", "\r\n\r\n"),
]


def run(spark, tmp_path, rows, least=0):
    pages = spark.createDataFrame([(*r, "noise") for r in rows], "page_id long, url string, html string, uuid string")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, least=least)
    records = warc.read_records(spark, path, payloads=True)
    return records, warc.captures_of(warc.assemble(records)).collect()


def test_round_trip(spark, tmp_path):
    records, got = run(spark, tmp_path, ROWS)
    assert records.count() == 3 * len(ROWS)
    assert all(r.digest_ok for r in records.filter("record_type = 'response'").collect())
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert sorted((r.payload_bytes, r.payload_digest, str(r.page_id)) for r in got) == sorted((len((h or "").encode()), digest(h), str(p)) for p, _, h in ROWS)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "response", None), ("1", "revisit", 1), ("2", "revisit", 1), ("None", "revisit", 1), ("3", "response", None),
                            ("4", "revisit", 3), ("5", "response", None), ("6", "response", None), ("7", "response", None)])


def test_small_payloads_are_responses(spark, tmp_path):
    _, got = run(spark, tmp_path, ROWS, least=9)
    assert {r.record_type for r in got} == {"response"}


def test_empty(spark, tmp_path):
    _, got = run(spark, tmp_path, [])
    assert got == []
