import base64
import glob
import gzip
import hashlib
import os

from tallywell.llm import warc
from tallywell.session import shared_dir

PAGES = [
    (1, "http://a/1", "<p>é</p>", "x"), (2, "http://a/2", "same", None), (3, None, "same", "y"), (4, "u\nv w", "same", "z"),
    (5, "http://a/5", None, None), (6, "http://a/6", "", "q"), (7, "http://a/7", "x" * 300_000, ""), (2, "http://a/2", "same", "r"),
    (None, "http://n", "same", "s"), (9, "http://a/9", "WARC/1.1\r\n\r\nodd\r\n\r\n", "t"),
]
SCHEMA = "page_id long, url string, html string, payload string"


def expected(pages, least=0):
    first = {}
    for i, _, html, _ in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html, _ in pages:
        raw = (html or "").encode()
        target = first[html or ""] if i is not None and len(raw) >= least and first[html or ""] != i else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "response" if target is None else "revisit", target))
    return sorted(out, key=repr)


def result(df):
    keys = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=repr)


def test_round_trip_of_every_case(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    for least in (0, 5):
        assert result(warc.round_trip(pages, least)) == expected(PAGES, least)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_plain_warc_and_the_index_finds_each_record(spark):
    root = shared_dir(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), root, archive_bytes=2000)
    found = sorted(map(tuple, index.select("archive", "offset", "length", "url", "payload_digest").collect()))
    assert len({a for a, *_ in found}) > 1
    whole = 0
    for path in glob.glob(f"{root}/*.warc.gz"):
        raw = open(path, "rb").read()
        text = gzip.decompress(raw)
        whole += text.count(b"WARC-Record-ID")
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    assert whole == len(PAGES)
    for archive, offset, length, _, digest in found:
        raw = open(os.path.join(root, archive), "rb").read()[offset : offset + length]
        assert warc.parse(gzip.decompress(raw))["payload_digest"] == digest
    some = index.where("page_id in (1, 7)")
    for size, gap in ((1, 0), (1 << 20, 1 << 20)):
        got = warc.read_records(some, root, size, gap).select("page_id", "payload").collect()
        assert {(r[0], bytes(r[1])) for r in got} == {(1, "<p>é</p>".encode()), (7, b"x" * 300_000)}
