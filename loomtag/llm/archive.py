"""Web archives: ARC files of versions 1 and 2 are read by their declared lengths and become WARC records.

An ARC file begins with a version block that names its version and the fields of
the header lines that follow; each record is such a line and as many bytes as its
last field declares. A record gets the WARC identifier, date, type and digests that
the older format lacks. Repeated payloads become revisits.

Records are written by Spark's text writer, whose line separator is the end of a
record, compressed file by file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.llm.shared import new_path, saved

#: Fields of a header line by ARC version (fixed by the format).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of one archive file, records of one WARC file, least payload bytes of a revisit.
FILE_BYTES, FILE_RECORDS, LEAST_REVISIT = 16 << 20, 2_000, 100
CAPTURED = "20240101000000"
_ARC_SCHEMA = pa.schema([
    ("version", pa.int32()), ("position", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()),
    ("declared", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()), ("key", pa.int64()),
])
_WARC_SCHEMA = pa.schema([("fields", pa.map_(pa.string(), pa.string())), ("head", pa.binary()), ("payload", pa.binary())])


def _http(payload: bytes, key: int | None) -> bytes:
    own = b"" if key is None else b"X-Page-Id: %d\r\n" % key
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def _arc_record(version: int, url: str, content: bytes, position: int) -> bytes:
    spaceless = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "unknown:"
    more = "" if version == 1 else f" 200 - - {position} {CAPTURED}.arc"
    return f"{spaceless} 0.0.0.0 {CAPTURED} text/html{more} {len(content)}\n".encode() + content


def _version_block(version: int) -> bytes:
    body = f"{version} 0 loomtag\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    more = "" if version == 1 else " 200 - - 0 -"
    return f"filedesc://{CAPTURED}.arc 0.0.0.0 {CAPTURED} text/plain{more} {len(body)}\n".encode() + body


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One ARC record for each page, in files of about FILE_BYTES (and one record, where that is longer); files of both versions.

    Equal pages are dealt over the files like others. Null html is empty, a null url `unknown:`; a null key is left out of the HTTP head.
    """
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    total = rows.agg(F.sum(F.octet_length("payload") + 512)).first()[0] or 0
    files = max(2, -(-int(total) // FILE_BYTES))

    def run(batches):
        from pyspark import TaskContext

        version, position = 1 + TaskContext.get().partitionId() % 2, 0
        for batch in batches:
            out = [] if position else [_version_block(version)]
            for key, url, payload in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload")), strict=True):
                position += 1
                out.append(_arc_record(version, url, _http(payload, key), position))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # a partition is a file: its first row is the version block; the number of a row deals out equal rows too
    records = rows.repartition(files, "key", "url", F.xxhash64("payload"), "row").drop("row").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _number(text: str) -> int | None:
    """A number of at most 18 ASCII digits."""
    return int(text) if re.fullmatch(r"[0-9]{1,18}", text) else None


def parse_arc(data: bytes) -> Iterator[tuple[int, int, list[str], bytes]]:
    """(version, position, header fields, content) of each record; the version block is the first.

    A line that is no header of the file's version, or that declares no length in
    digits, is skipped, so that reading goes on behind a damaged record; a length
    beyond the end of the file gives what there is.
    """
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        fields = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        length = _number(fields[-1])
        block = fields[0].startswith("filedesc:") and len(fields) > 3
        if length is None or not block and not (len(fields) == len(ARC_FIELDS[version]) and _number(fields[2]) is not None):
            at = end + 1
            continue
        content = data[end + 1 : end + 1 + length]
        if block:
            named = _number(content.split(b"\n", 1)[0].split(b" ")[0].decode("utf-8", "replace"))
            version = named if named in ARC_FIELDS else 1
        yield version, at, fields, content
        at = end + 1 + length


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    if not content.startswith(b"HTTP/"):
        return b"", content
    cut = content.find(b"\r\n\r\n")
    return (content, b"") if cut < 0 else (content[: cut + 4], content[cut + 4 :])


def _header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def _unzipped(data: bytes) -> bytes:
    """All members of a gzip file, or the data itself if it isn't one; of a damaged or cut member, what comes before the damage."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member, at = zlib.decompressobj(31), 0
        try:
            while at < len(data) and not member.eof:
                out.append(member.decompress(data[at : at + (1 << 20)]))
                at += 1 << 20
        except zlib.error:
            break
        data = member.unused_data + data[at:]
    return b"".join(out)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 200
        if total > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files below path: their path and content. A file is read by one task, at most 2 GB of it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


_ARC_DDL = "version int, position long, url string, ip string, date string, mime string, declared long, head binary, payload binary, key long"


def _arc_rows(data: bytes) -> Iterator[tuple]:
    """A tuple in the order of _ARC_SCHEMA for each record of an ARC file."""
    for version, at, f, content in parse_arc(_unzipped(data)):
        head, payload = _split_http(content)
        key = _header(head, b"X-Page-Id") or ""
        number = _number(key.removeprefix("-"))
        yield version, at, f[0], f[1], f[2], f[3], _number(f[-1]), head, payload, None if number is None else -number if key.startswith("-") else number


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """All ARC records below path (version blocks too): version, position, url, ip, date, mime, declared, head, payload, key."""

    def run(batches):
        rows = (r for batch in batches for data in batch.column("content") for r in _arc_rows(data.as_py()))
        yield from _batched(rows, _ARC_SCHEMA, lambda r: len(r[8]))

    return _files(spark, path).select("content").mapInArrow(run, _ARC_DDL)


def _iso(date: Column) -> Column:
    """An ARC date of 4 to 14 digits as a WARC date; missing parts are the least possible."""
    full = F.concat(date, F.substring(F.lit("00000101000000"), F.length(date) + 1, F.lit(14)))
    parts = [F.substring(full, a, n) for a, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    return F.format_string("%s-%s-%sT%s:%s:%sZ", *parts)


def _kind(url: Column, is_http: Column) -> Column:
    return F.when(url.startswith("filedesc:"), "warcinfo").when(url.startswith("dns:"), "resource").when(is_http, "response").otherwise("resource")


def _record_id() -> Column:
    """An identifier from what tells a record: url, date, key, position and payload digest."""
    name = F.md5(F.concat_ws(" ", "url", "date", F.col("key").cast("string"), F.col("position").cast("string"), "digest").cast("binary"))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts, F.concat(F.lit("5"), F.substring(name, 14, 3)), F.concat(F.lit("a"), F.substring(name, 18, 3)), F.substring(name, 21, 12)))


def revisits(records: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """(path, position, refers_to, refers_to_id) of the records that revisit another; records holds no payload, but its digest and size.

    Of the records with equal payloads of at least least_revisit bytes the one with
    the least key is the response (all of them, if rows repeat that key) and the
    others revisit it; one without a key revisits it too, and is the response only
    where no record of the payload has a key.
    """
    large = records.where((F.col("kind") == "response") & (F.col("size") >= least_revisit))
    first = large.where(F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("refers_to"), F.min_by("record_id", "key").alias("refers_to_id"))
    again = large.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    met = large.join(again, "digest", "left_semi").join(first, "digest")
    return met.where(~F.col("key").eqNullSafe(F.col("refers_to"))).select("path", "position", "refers_to", "refers_to_id")


def to_warc(spark: SparkSession, path: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """The ARC records below path with what WARC asks for: kind, record_id, warc_date, payload digest, and refers_to for revisits.

    Files are read twice. The first time only digests leave the task, and rows
    without payloads decide what revisits what, so that a page with very many copies
    moves none of them. The verdicts come back as one list for each file, joined to
    the file by its path.
    """
    short = pa.schema([("path", pa.string()), *[f for f in _ARC_SCHEMA if f.name in ("position", "url", "date", "key")], ("digest", pa.string()), ("size", pa.int64()), ("http", pa.bool_())])

    def digests(batches):
        def rows():
            for batch in batches:
                for where, data in zip(batch.column("path"), batch.column("content"), strict=True):
                    for _, at, url, _, date, _, _, head, payload, key in _arc_rows(data.as_py()):
                        yield where.as_py(), at, url, date, key, hashlib.sha256(payload).hexdigest(), len(payload), bool(head)

        yield from _batched(rows(), short, lambda r: 300)

    files = _files(spark, path)
    records = files.mapInArrow(digests, "path string, position long, url string, date string, key long, digest string, size long, http boolean")
    records = records.select("path", "position", "key", "digest", "size", _kind(F.col("url"), F.col("http")).alias("kind"), _record_id().alias("record_id"))
    found = revisits(saved(records, "digests"), least_revisit)
    verdicts = found.groupBy(F.col("path").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("refers_to", "refers_to_id")))).alias("verdicts"))  # of one file's records
    verdicts = saved(verdicts, "verdicts")
    out = pa.schema([*_ARC_SCHEMA, ("refers_to", pa.int64()), ("refers_to_id", pa.string())])

    def convert(batches):
        def rows():
            for batch in batches:
                for data, known in zip(batch.column("content"), batch.column("verdicts"), strict=True):
                    known = dict(known.as_py() or ())
                    for r in _arc_rows(data.as_py()):
                        other = known.get(r[1]) or {"refers_to": None, "refers_to_id": None}
                        yield *r, other["refers_to"], other["refers_to_id"]

        yield from _batched(rows(), out, lambda r: len(r[8]))

    met = files.join(verdicts, F.col("path") == F.col("of"), "left").select("content", "verdicts")
    rows = met.mapInArrow(convert, f"{_ARC_DDL}, refers_to long, refers_to_id string").withColumn("digest", F.sha2("payload", 256))
    kind = F.when(F.col("refers_to_id").isNotNull(), "revisit").otherwise(_kind(F.col("url"), F.octet_length("head") > 0))
    return rows.withColumns({"kind": kind, "record_id": _record_id(), "warc_date": _iso(F.col("date"))})


def write_warc(records: DataFrame, path: str) -> None:
    """The records as WARC/1.1; the block of a revisit is its HTTP head."""
    block = F.when(F.col("kind") == "revisit", F.col("head")).otherwise(F.concat("head", "payload"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    http = F.when(F.octet_length("head") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("warc_date")), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")), line("Content-Type", http),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">"))), line("WARC-Profile", F.when(F.col("kind") == "revisit", REVISIT_PROFILE)),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    texts = records.withColumn("block", block).select(F.concat(F.encode(head, "UTF-8"), "block").cast("string").alias("value"))
    texts.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by Content-Length.

    A header without an end, or without a length in digits, is skipped: reading goes
    on at the next line that looks like the first one of a record.
    """
    at = 0 if data.startswith(b"WARC/") else _next_warc(data, 0)
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}
        size = next((_number(v) for k, v in fields.items() if k.lower() == "content-length"), None)
        if size is None:
            at = _next_warc(data, at + 5)
            continue
        yield fields, data[end + 4 : end + 4 + size]
        at = _next_warc(data, end + 4 + size)


def _next_warc(data: bytes, at: int) -> int:
    """The next place from `at` on where a line begins with WARC/, or -1."""
    while (at := data.find(b"WARC/", at)) > 0 and data[at - 1 : at] != b"\n":
        at += 5
    return at


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All WARC records below path: fields (a map), head (of HTTP), payload, digest (of the payload as read), intact.

    intact says whether the payload, or the block of a revisit, has the digest that its header gives; null without one.
    """

    def run(batches):
        def rows():
            for batch in batches:
                for data in batch.column("content"):
                    for fields, block in parse_warc(_unzipped(data.as_py())):
                        yield list(fields.items()), *_split_http(block)

        yield from _batched(rows(), _WARC_SCHEMA, lambda r: len(r[2]))

    found = _files(spark, path).select("content").mapInArrow(run, "fields map<string,string>, head binary, payload binary")
    stored = lambda name: F.regexp_replace(F.col("fields")[name], "^sha256:", "")
    digest = F.sha2("payload", 256)
    sound = F.when(F.col("fields")["WARC-Type"] == "revisit", F.sha2(F.concat("head", "payload"), 256) == stored("WARC-Block-Digest")).otherwise(digest == stored("WARC-Payload-Digest"))
    return found.select("*", digest.alias("digest"), sound.alias("intact"))


def converted(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages through both formats: ARC files, WARC files, and what they say of each page.

    Returns (key_col, payload_bytes, payload_digest, record_type, refers_to), one row
    per page, the first two of the full payload also for revisits. Null html is an
    empty payload, a null url `unknown:`; pages without a key come back without one.
    Rows that repeat a key are records of their own, all responses where that key is
    the least of their payload. A very long page is one record. An empty table gives
    no rows; columns besides the three named are ignored.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, key_col, url_col, html_col)
    write_warc(to_warc(spark, arc), warc)
    found = read_warc(spark, warc).where(F.col("fields")["WARC-Type"] != "warcinfo")
    head, again = F.decode("head", "UTF-8"), F.col("fields")["WARC-Type"] == "revisit"

    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(head, pattern, 1), F.lit("")).try_cast("long")

    return found.select(
        number(r"X-Page-Id: (-?\d+)").alias(key_col),
        # of responses from the payload that was read back; revisits have none
        F.when(again, number(r"Content-Length: (\d+)")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(again, F.regexp_replace(F.col("fields")["WARC-Payload-Digest"], "^sha256:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("fields")["WARC-Type"].alias("record_type"),
        F.col("fields")["X-Refers-To-Page-Id"].cast("long").alias("refers_to"),
    )


#: DuckDB SQL for converted over pages.
SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
