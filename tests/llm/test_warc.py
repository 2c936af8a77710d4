import io
import zipfile

import pytest

from reviewloom.llm import warc
from reviewloom.llm.queries import ORACLES, QUERIES
from reviewloom.llm.warc import Package, archived, read_archives, read_record, record_bytes, write_archives, zip_package
from tests.compare import differences, duck


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    problem, n = differences(spark, duck(sf), QUERIES["op10_packaged_archives"], ORACLES["op10_packaged_archives"], sf)
    assert not problem and n == 250


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_plain_zip_files(zip64):
    members = [("archive/data.warc.gz", b"abc" * 100), ("indexes/é.cdxj", b""), ("x", bytes(range(256)))]
    data = zip_package(members, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:  # an independent reader
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    package = Package(lambda at, n: data[at:at + n], len(data))
    for name, content in members:
        at, size = package.place(name)
        assert data[at:at + size] == content


def test_packages_of_other_writers_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"stored")
        z.writestr("b", b"packed" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    data = out.getvalue()
    package = Package(lambda at, n: data[at:at + n], len(data))
    at, size = package.place("a")
    assert data[at:at + size] == b"stored"
    with pytest.raises(ValueError):
        package.place("b")
    with pytest.raises(ValueError):
        Package(lambda at, n: b"x" * n, 100)


def test_records_come_back():
    member, digest = record_bytes(7, "http://x/ä b\r\n", b"\r\n\r\npayload\r\n", None)
    fields, block = read_record(member)
    assert fields["WARC-Type"] == "response" and block.partition(b"\r\n\r\n")[2] == b"\r\n\r\npayload\r\n" and digest in fields["WARC-Payload-Digest"]
    fields, block = read_record(record_bytes(8, None, b"payload", 7)[0])
    assert fields["WARC-Refers-To"] == "<urn:page:7>" and b"payload" not in block


@pytest.mark.parametrize("options", [{}, {"zip64": True, "package_bytes": 300}, {"min_bytes": 3}])
def test_odd_rows(spark, options):
    pages = [(4, "u", "same"), (2, None, "same"), (9, "u", "same"), (2, "u", "same"), (None, "u", "same"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 50_000), (None, "u", "lonely"), (8, "u", "\r\n\r\n")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    got = sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in archived(df, **options).collect()), key=str)
    empty = [(5, 0, "response", None), (6, 0, "response", None) if options.get("min_bytes") else (6, 0, "revisit", 5)]
    want = [(4, 4, "revisit", 2), (2, 4, "response", None), (9, 4, "revisit", 2), (2, 4, "response", None), (-1, 4, "revisit", 2), *empty, (7, 100_000, "response", None), (-1, 6, "response", None), (8, 4, "response", None)]
    assert got == sorted(want, key=str)


def test_payloads_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} é") for i in range(30)], "page_id long, url string, html string")
    packages = write_archives(df, f"file://{tmp_path}/a", package_bytes=2000).cache()
    assert packages.count() > 1 and sum(r.records for r in packages.collect()) == 30
    assert {r.page_id: bytes(r.payload).decode() for r in read_archives(packages).collect()} == {str(i): f"page {i} é" for i in range(30)}
    assert archived(df.limit(0)).collect() == []


def test_a_package_is_written_without_copies_of_its_data():
    import tracemalloc

    data = bytearray(b"x" * (8 << 20))
    members = [("archive/data.warc.gz", data), ("indexes/index.cdxj", b"y")]
    tracemalloc.start()
    size = sum(len(part) for part in warc.zip_parts(members))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == len(warc.zip_package(members)) and peak < 1 << 20


def test_pages_reach_the_tasks_in_small_batches(spark, monkeypatch):
    seen = []
    kept = warc.written
    monkeypatch.setattr(warc, "written", lambda df, name: (seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")), kept(df, name))[1])
    pages = spark.createDataFrame([(1, "u", "h"), (2, "v", "h")], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 2 and seen == ["4m"]
