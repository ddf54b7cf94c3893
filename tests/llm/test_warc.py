import hashlib
import io
from base64 import b32encode

import pytest

from mnemoflow.llm import common, warc

PAGES = [(5, "http://a/\r\nx", "same"), (3, "http://b", "same"), (9, None, "same"), (3, "http://b", "same"), (1, "http://c", None), (2, "http://d", ""), (7, "http://e", "é" * 200_000), (None, "http://f", "same"), (None, "http://g", "alone"), (4, "http://h", "x\r\n\r\ny\r\n")]


def run(spark, rows, **options):
    root = common.scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(*r, 0, "q") for r in rows], "page_id long, url string, html string, digest int, first string")
    manifest = warc.write_archives(df, root, **options)
    return manifest, warc.read_archives(manifest, root, payloads=True).collect()


@pytest.mark.parametrize("least", [0, 3, 100])
def test_round_trip(spark, least):
    _, got = run(spark, PAGES, min_payload=least, file_bytes=300)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        ids = [j for j, _, h in PAGES if (h or "").encode() == raw and j is not None]
        first = min(ids) if ids and len(raw) >= least and (i is None or min(ids) < i) else None
        want.append((i, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if first is not None else "response", first))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all(bytes(r.payload) == dict((i, (h or "").encode()) for i, _, h in PAGES)[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_archives_are_frames_behind_a_dictionary(spark):
    rows = [(i, f"http://x/{i}", f"<html><body><p>page number {i} with common words</p></body></html>") for i in range(300)]
    manifest, got = run(spark, rows)
    assert len(got) == 300 and manifest.agg({"records": "sum"}).first()[0] == 300
    raw = open(manifest.first().path, "rb").read()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(raw[4:8], "little") > 100
    records = list(warc.read_frames(io.BytesIO(raw), chunk=50))
    assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and all(r.endswith(b"\r\n\r\n") for r in records)
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(raw[:-5])))


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    root = common.scratch_path(spark, "warc-test")
    manifest = warc.write_archives(df, root)
    assert manifest.count() == 0 and warc.read_archives(manifest, root).collect() == []
