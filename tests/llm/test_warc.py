import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hushlake.llm.warc import LoserTree, archive, base32, histories, read_archives, records, url_key, verified, write_archives
from hushlake.plans.storage import work_dir
from tests.llm.conftest import PAGES

ROWS = [
    (3, "http://b.example.org/x?q=1#f", "<p>ä€😀</p>"), (1, "https://B.example.org:8080/X", "<p>ä€😀</p>"), (2, None, None), (4, "no scheme", ""),
    (5, "http://a.example.org/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"), (6, "http://a.example.org/", "\r\n\r\n"),
    (7, "http://a.example.org/a b\r\nInjected: 1", "line\nline\rline\r\n"), (8, "x", "y" * 300_000), (9, "x", "y" * 300_000), (9, "x", "y" * 300_000), (None, "z", "y" * 300_000),
    (-1, "z", "only"), (10, "z", " \x00 nul"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "p", "r") for r in ROWS], PAGES).repartition(3)


def want():
    payload = {i: (h or "").encode() for i, _, h in ROWS}
    out = []
    for i, _, h in ROWS:
        blob = (h or "").encode()
        first = min(j for j, b in payload.items() if b == blob and j is not None)
        again = i != first
        digest = base64.b32encode(hashlib.sha1(blob).digest()).decode()
        out.append((i, len(blob), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_archive_round_trip(spark, pages):
    got = archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == want()
    assert archive(spark.createDataFrame([], PAGES)).count() == 0


def test_files_are_warc_records_and_give_payloads_back(spark, pages):
    folder = work_dir(spark, "warc")
    write_archives(records(pages), folder, "one")
    rows = read_archives(spark, folder, "one").collect()
    html = {i: h or "" for i, _, h in ROWS}
    assert all(r.payload == (html[r.page_id] if r.record_type == "response" else "") for r in rows) and len(rows) == len(ROWS)
    files = [gzip.decompress(r.content) for r in spark.read.format("binaryFile").load(f"{folder}/*.gz").collect()]
    count = 0
    for data in files:
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n" and b"Injected" not in fields
            data, count = rest[size + 4 :], count + 1
    assert count == len(ROWS)


def test_damaged_archives_fail(spark, tmp_path):
    """A payload that was changed or cut, or a response that is gone, does not give the rows of the whole archive."""
    rows = [(1, "http://a.example/x", "first page"), (2, "http://a.example/y", "first page"), (3, "http://a.example/z", "another")]
    folder = work_dir(spark, "warc")
    write_archives(records(spark.createDataFrame([(*r, "p", "r") for r in rows], PAGES).coalesce(1)), folder, "one")
    data = b"".join(gzip.decompress(r.content) for r in spark.read.format("binaryFile").load(f"{folder}/*.gz").collect())

    def got(name, data):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt.gz").write_bytes(gzip.compress(data))
        found = verified(read_archives(spark, str(tmp_path / name), "one"))
        return sorted((r.page_id, r.payload_bytes, r.record_type) for r in found.collect())

    assert got("whole", data) == [(1, 10, "response"), (2, 10, "revisit"), (3, 7, "response")]
    parts = data.split(b"WARC/1.1\r\n")
    gone = b"WARC/1.1\r\n".join(p for p in parts if b"<urn:page:1>\r\nWARC-Date" not in p)
    for name, broken in {"changed": data.replace(b"another", b"an0ther"), "cut": data.replace(b"another", b"anoth"), "gone": gone}.items():
        assert broken != data
        with pytest.raises(Exception, match="damaged record of page"):
            got(name, broken)


def test_base32_and_keys(spark):
    texts = [str(n) for n in range(50)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", base32(F.sha1("t")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in got)
    urls = {"https://m.Site.example/en/25#top": "example,site,m)/en/25", None: ")", "ftp://u@h.x": "x,h)"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in got} == urls


@pytest.mark.parametrize("k", range(8))
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 9), n) for n in range(rng.randint(0, 20))) for _ in range(k)]
    assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_histories_are_globally_ordered(spark, monkeypatch):
    monkeypatch.setattr("hushlake.llm.warc.RUN_ROWS", 7)
    monkeypatch.setattr("hushlake.llm.warc.BUCKET_ROWS", 60)
    monkeypatch.setattr("hushlake.llm.warc.FAN_IN", 3)
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([1, 2, 3, None]), n, "response", None, "d") for n in range(400)]
    captures = spark.createDataFrame(rows, "url_key string, captured long, page_id long, record_type string, refers_to long, payload_digest string")
    got = sorted(histories(captures.repartition(5)).collect(), key=lambda r: (r.bucket, r.nth))
    key = lambda r: tuple((v is not None, v) for v in r[:3])
    assert [tuple(r[:3]) for r in got] == [r[:3] for r in sorted(rows, key=key)]
    assert len({r.bucket for r in got}) > 3
