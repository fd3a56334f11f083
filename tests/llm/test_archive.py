import gzip
import hashlib

from compare import assert_same
from fixtures import SF

from loomtag.llm import archive, queries


def test_query_equals_sql(spark):
    assert_same(queries.op2_arc_to_warc(spark, SF), archive.SQL)


def test_awkward_pages(spark):
    big = "x" * 200
    pages = [(3, "http://a/ b\n", big), (2, None, big), (2, None, big), (None, "u", big), (5, "u", None), (6, "u", ""), (7, "u", "y" * 99), (8, "u", "y" * 99), (-1, "u", "\r\n\r\nWARC/1.1\r\n" + "é" * 60000)]
    df = spark.createDataFrame([(*p, "fields", b"h") for p in pages], "page_id long, url string, html string, fields string, head binary")
    got = sorted((tuple(r) for r in archive.converted(df).collect()), key=str)
    expected = []
    for key, _, html in pages:
        data = (html or "").encode()
        other = html == big and key != 2
        expected.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", 2 if other else None))
    assert got == sorted(expected, key=str)
    assert archive.converted(df.where("false")).count() == 0


def test_both_versions_and_damage():
    for version in (1, 2):
        data = archive._version_block(version) + b"\n" + archive._arc_record(version, "http://x/", b"HTTP/1.1 200 OK\r\n\r\nhello\nworld", 1) + b"\n"
        data += b"garbage line\n" + archive._arc_record(version, "dns:x", b"1.2.3.4", 2) + b"\n" + archive._arc_record(version, "http://cut/", b"abc", 3)[:-1]
        found = list(archive.parse_arc(archive._unzipped(gzip.compress(data[:50]) + gzip.compress(data[50:]))))
        assert [f[0] for f in found] == [version] * 4
        assert [f[3] for f in found][1:] == [b"HTTP/1.1 200 OK\r\n\r\nhello\nworld", b"1.2.3.4", b"ab"]
        assert [f[2][0] for f in found][1:] == ["http://x/", "dns:x", "http://cut/"]


def test_damaged_archives_are_read_as_far_as_they_go():
    good = archive._arc_record(1, "http://x/", b"body", 1) + b"\n"
    for bad in ("http://x/ 1.1.1.1 19961022 text/html ²\n".encode(), b"http://x/ 1.1.1.1 19961022 text/html " + b"9" * 5000 + b"\n", "http://x/ 1.1.1.1 ²³ text/html 4\n".encode(), b"filedesc: x\n", b"\xff\xfe\n"):
        found = list(archive.parse_arc(archive._version_block(1) + b"\n" + bad + good))
        assert [f[3] for f in found][1:] == [b"body"]
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    assert [b for _, b in archive.parse_warc(record + record)] == [b"body"] * 2
    for bad in (b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", "WARC/1.1\r\nContent-Length: ²\r\n\r\n".encode(), b"junk WARC/ junk\r\n\r\n"):
        assert [b for _, b in archive.parse_warc(record + bad + record)] == [b"body"] * 2
    assert [b for _, b in archive.parse_warc(record + b"WARC/1.1\r\nContent-Le")] == [b"body"]
    assert list(archive.parse_warc(b"")) == [] and list(archive.parse_arc(b"")) == []
    packed = gzip.compress(good * 50)
    for cut in (packed[:-20], packed[:40] + b"\x00\xff" + packed[42:], packed[:12], packed + b"\x1f\x8b\x00"):
        assert (good * 50).startswith(archive._unzipped(cut)[: len(good)])


def test_synthesised_fields(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nX-Page-Id: %d\r\n\r\n"
    lines = [(b"dns:x 1.1.1.1 1996 text/dns", b"1.2.3.4"), (b"http://x/ 1.1.1.1 199610221530 text/html", http % 4 + b"body")]
    lines += [(b"http://y/ 1.1.1.1 19961022153000 text/html", http % k + b"z" * 150) for k in (9, 7, 8)]
    (tmp_path / "a.arc").write_bytes(archive._version_block(1) + b"\n" + b"".join(b"%s %d\n%s\n" % (a, len(b), b) for a, b in lines))
    rows = [r for r in archive.to_warc(spark, f"file://{tmp_path}").collect() if r["kind"] != "warcinfo"]
    got = {r["url"]: r for r in rows}
    assert (got["dns:x"]["kind"], got["dns:x"]["warc_date"]) == ("resource", "1996-01-01T00:00:00Z")
    assert (got["http://x/"]["kind"], got["http://x/"]["warc_date"]) == ("response", "1996-10-22T15:30:00Z")
    assert len({r["record_id"] for r in rows}) == 5 and all(len(r["record_id"]) == 45 for r in rows)
    ids = {r["key"]: r["record_id"] for r in rows}
    assert {(r["key"], r["kind"], r["refers_to"], r["refers_to_id"]) for r in rows if r["url"] == "http://y/"} == {(7, "response", None, None), (8, "revisit", 7, ids[7]), (9, "revisit", 7, ids[7])}


def test_a_hot_page_moves_no_payload(spark):
    # a third of the pages are copies of one: the tasks that decide on revisits see digests alone
    rows = [(i, "http://hot/" if i % 3 == 0 else f"http://h{i}/", "hot" * 100 if i % 3 == 0 else f"own {i} " * 30) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in archive.converted(df).collect()}
    assert got == {i: ("revisit", 0) if i % 3 == 0 and i else ("response", None) for i in range(3000)}
    columns = archive.revisits(spark.createDataFrame([], "path string, position long, key long, digest string, size long, kind string, record_id string")).columns
    assert columns == ["path", "position", "refers_to", "refers_to_id"]


def test_a_flipped_byte_shows(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", ("same page " if i < 3 else f"page {i} ") * 30) for i in range(6)], "page_id long, url string, html string")
    arc, warc = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    archive.write_arc(pages, arc)
    archive.write_warc(archive.to_warc(spark, arc), warc)
    assert all(r["intact"] for r in archive.read_warc(spark, warc).where("fields['WARC-Type'] <> 'warcinfo'").collect())
    bad = 0
    for f in (tmp_path / "warc").glob("*.gz"):
        data = gzip.decompress(f.read_bytes())
        bad += data.count(b"page 4 ") > 0
        f.write_bytes(gzip.compress(data.replace(b"page 4 ", b"page 5 ", 1).replace(b"X-Page-Id: 2", b"X-Page-Id: 9")))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    found = {r["fields"]["WARC-Target-URI"]: r["intact"] for r in archive.read_warc(spark, warc).where("fields['WARC-Type'] <> 'warcinfo'").collect()}
    assert bad == 1 and found == {f"http://h/{i}": i not in (2, 4) for i in range(6)}  # a payload, and the block of a revisit


def test_equal_rows_lie_in_several_files(spark, tmp_path):
    rows = spark.range(50_000).selectExpr("CAST(NULL AS LONG) AS page_id", "CAST(NULL AS STRING) AS url", "'' AS html")
    rows = rows.unionByName(spark.range(100).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 400000) AS html"))
    archive.write_arc(rows, f"file://{tmp_path}/arc")
    counts = [gzip.decompress(f.read_bytes()).count(b"unknown:") for f in (tmp_path / "arc").glob("*.gz")]
    assert len(counts) == 4 and sum(counts) == 50_000 and max(counts) < 1.1 * 50_000 / 4
