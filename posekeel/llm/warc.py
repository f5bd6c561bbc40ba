"""WARC archives: write, read back, and resolve revisits.

Records are formatted as columns and written by Spark's text writer, whose
line separator is the two line ends that close a record; so archives go to
any store Spark writes to, and task retries replace whole files.  A file is
one gzip stream; payloads above a limit go to files of a few records, so that
files are bounded by bytes, too.  Reading goes by Content-Length, never by
separator, so payloads may hold anything, and inflates a file piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, work_folder

#: fixed values of the format
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: records of a file at most, and of one that has payloads above the limit
FILE_RECORDS = 1000
LARGE_FILE_RECORDS = 8
LARGE_PAYLOAD = 256 << 10
#: bytes that are inflated at once, and payload bytes of a batch of rows
PIECE = 1 << 18
BATCH_PAYLOAD = 4 << 20
CAPTURED = "2024-01-01T00:00:00Z"

HEADERS = "record_id string, record_type string, page_id string, uri string, captured string, payload_bytes long, payload_digest string, refers_to string, refers_id string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_FROM, BASE32_TO)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def _uuid(*values: Column) -> Column:
    h = F.md5(F.concat_ws("\u0001", *values))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def record_text(payload: Column | None) -> Column:
    """One record without its end.  Uses the columns of HEADERS; ``payload``
    is given for responses only."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, payload) if payload is not None else http
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(line(name, _one_line(value)))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("captured")),
        optional("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        optional("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(REVISIT_PROFILE))),
        optional("WARC-Refers-To", F.when(F.col("refers_id").isNotNull(), F.concat(F.lit("<"), F.col("refers_id"), F.lit(">")))),
        optional("X-Page-Id", F.col("page_id")),
        optional("X-Refers-To-Page-Id", F.col("refers_to")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + (F.col("payload_bytes") if payload is not None else F.lit(0))).cast("string"),
        F.lit("\r\n\r\n"),
        block,
    )


def write_archives(records: DataFrame, path: str, large: bool | None = None) -> None:
    """Write a column of record texts (value) as gzip-compressed archives.
    Rows whose payload_bytes are above LARGE_PAYLOAD are written apart, if there
    are such rows: ``large`` says so, or else the first write counts them."""
    seen = Observation()
    if large is None:
        records = records.observe(seen, F.count(F.when(F.col("payload_bytes") > LARGE_PAYLOAD, 1)).alias("n"))
    writer = lambda df, n: df.select("value").write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", n).text(path)
    writer(records.where(F.col("payload_bytes") <= LARGE_PAYLOAD), FILE_RECORDS)
    if seen.get["n"] > 0 if large is None else large:
        writer(records.where(F.col("payload_bytes") > LARGE_PAYLOAD), LARGE_FILE_RECORDS)


class _Bytes:
    """The bytes of an archive, plain or in any number of gzip members,
    inflated as they are asked for; ``held[pos:]`` are those not yet passed."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.pos = memoryview(data), 0, b"", 0
        self.gzip = data[:2] == b"\x1f\x8b"
        self.stream = zlib.decompressobj(31)

    def _more(self) -> bool:
        piece = bytes(self.data[self.at : self.at + PIECE])
        self.at += len(piece)
        if self.gzip and self.stream.eof:
            piece = self.stream.unused_data + piece
            self.stream = zlib.decompressobj(31)
        if not piece:
            return False
        self.held = self.held[self.pos :] + (self.stream.decompress(piece) if self.gzip else piece)
        self.pos = 0
        return True

    def until(self, sign: bytes) -> bytes | None:
        """What comes before ``sign``, which is passed; None at the end."""
        tried = 0  # bytes past pos that do not begin it
        while (found := self.held.find(sign, self.pos + tried)) < 0:
            tried = max(0, len(self.held) - self.pos - len(sign) + 1)
            if not self._more():
                return None
        out, self.pos = self.held[self.pos : found], found + len(sign)
        return out

    def take(self, n: int) -> bytes:
        parts: list[bytes] = []
        while n > len(self.held) - self.pos:
            parts.append(self.held[self.pos :])
            n -= len(parts[-1])
            self.pos = len(self.held)
            if not self._more():
                raise ValueError("an archive ends inside a record")
        parts.append(self.held[self.pos : self.pos + n])
        self.pos += n
        return b"".join(parts)

    def skip_ends(self) -> bool:
        """Pass line ends between records; whether there is another record."""
        while True:
            while self.held[self.pos : self.pos + 1] in (b"\r", b"\n"):
                self.pos += 1
            if self.pos < len(self.held):
                return True
            if not self._more():
                return False


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of an archive, plain or gzip."""
    source = _Bytes(data)
    while source.skip_ends():
        raw = source.until(b"\r\n\r\n")
        head = (raw or b"").decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        yield fields, source.take(int(fields["content-length"]))


def _record(fields: dict[str, str], block: bytes) -> tuple[tuple, bytes]:
    """The header row of a record, and its payload, whose digest is checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    said = {k.strip().lower(): v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    size = int(said.get(b"content-length", b"0")) if revisit else len(payload)
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = told if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != told:
        raise ValueError(f"payload digest does not match in {fields.get('warc-record-id')}")
    refers = fields.get("warc-refers-to", "").strip("<>") or None
    return (fields["warc-record-id"].strip("<>"), fields["warc-type"], fields.get("x-page-id"), fields.get("warc-target-uri"), fields["warc-date"], size, digest, fields.get("x-refers-to-page-id"), refers), payload


def _read(with_payload: bool):
    """Rows of HEADERS and path; ``with_payload`` adds the payload and, from the
    file's list of revisits, to_page and to_record (then without payload)."""
    names = [x.split()[0] for x in HEADERS.split(", ")]

    def rows_of(path: str, held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*[h[0] for h in held]))
        out = [pa.array(list(c), pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, columns)] + [pa.array([path] * len(held))]
        if not with_payload:
            return pa.RecordBatch.from_arrays(out, names=[*names, "path"])
        out += [pa.array([h[1] for h in held], pa.binary()), pa.array([h[2] for h in held], pa.string()), pa.array([h[3] for h in held], pa.string())]
        return pa.RecordBatch.from_arrays(out, names=[*names, "path", "payload", "to_page", "to_record"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (path, value) in enumerate(zip(batch.column("path"), batch.column("content"))):
                links = {}
                if with_payload:
                    links = {r["record_id"]: r for r in batch.column("revisits")[k].as_py() or ()}
                held, size = [], 0
                for fields, block in parse_records(value.as_py()):
                    row, payload = _record(fields, block)
                    link = links.get(row[0])
                    payload = payload if with_payload and link is None else b""
                    held.append((row, payload, link and link["to_page"], link and link["to_record"]))
                    size += len(payload)
                    if size >= BATCH_PAYLOAD or len(held) >= FILE_RECORDS:
                        yield rows_of(path.as_py(), held)
                        held, size = [], 0
                if held:
                    yield rows_of(path.as_py(), held)

    return run


LINKED = HEADERS + ", path string, payload binary, to_page string, to_record string"


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Headers of all records under ``path``, the path of their file and, on
    request, payloads.  The payloads' digests are computed anew and must agree
    with the headers."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if not payload:
        return files.mapInArrow(_read(False), HEADERS + ", path string")
    none = F.lit(None).cast("array<struct<record_id: string, to_page: string, to_record: string>>")
    return files.withColumn("revisits", none).mapInArrow(_read(True), LINKED).drop("to_page", "to_record")


def capture(pages: DataFrame, path: str, id_col: str, url_col: str, html_col: str) -> None:
    """Write one response record for each row."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    page, url = F.col(id_col).cast("string"), F.col(url_col)
    rows = pages.select(
        html.alias("_html"), page.alias("page_id"), url.alias("uri"), F.lit("response").alias("record_type"), F.lit(CAPTURED).alias("captured"),
        F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html).alias("payload_digest"),
        _uuid(F.coalesce(page, F.lit("")), F.monotonically_increasing_id().cast("string")).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("string").alias("refers_id"),
    )
    write_archives(rows.select(record_text(F.col("_html")).alias("value"), "payload_bytes"), path)


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = 0, id_type: str = "bigint") -> None:
    """Read archives from ``source`` and write deduplicated ones to ``target``.

    Only headers are shuffled by payload digest.  Of equal payloads of at least
    ``min_bytes`` bytes the record with the least page id (a missing one comes
    last; then the least record id) stays a response; the others become
    revisits of it without payload.  All records get fresh identifiers."""
    work = Workspace(spark)
    headers = work.put("headers", read_archives(spark, source))
    number = F.expr(f"try_cast(page_id as {id_type})")
    rank = F.struct(number.isNull().alias("none"), number.alias("id"), F.col("record_id").alias("record"), F.col("page_id").alias("page"))
    same = ["payload_digest", "payload_bytes"]
    firsts = work.put("firsts", headers.where(F.col("payload_bytes") >= min_bytes).groupBy(*same).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    # Each file gets a list of its revisits, bounded by the records of a file.
    # As a table its size is known: Spark broadcasts it if it is under the
    # session's limit, so that archives stay where they are; else the files
    # are moved as they are, compressed, not record by record.
    revisit = F.struct("record_id", F.col("first.page").alias("to_page"), F.col("first.record").alias("to_record"))
    lists = work.put(
        "revisits",
        headers.select("path", "record_id", *same).join(firsts, same).where(F.col("record_id") != F.col("first.record")).groupBy("path").agg(F.collect_list(revisit).alias("revisits")),
    )
    files = spark.read.format("binaryFile").load(source).select("path", "content").join(lists, "path", "left")
    records = files.mapInArrow(_read(True), LINKED)
    fresh = lambda c: _uuid(F.lit("fresh"), c)
    known = records.withColumns(
        {
            "record_type": F.when(F.col("to_record").isNull(), F.lit("response")).otherwise(F.lit("revisit")),
            "refers_to": F.col("to_page"),
            "refers_id": F.when(F.col("to_record").isNotNull(), fresh(F.col("to_record"))),
            "record_id": fresh(F.col("record_id")),
        }
    )
    text = F.when(F.col("record_type") == "response", record_text(F.col("payload").cast("string"))).otherwise(record_text(None))
    large = not headers.where(F.col("payload_bytes") > LARGE_PAYLOAD).isEmpty()
    write_archives(known.select(text.alias("value"), "payload_bytes"), target, large)
    work.drop("headers", "firsts", "revisits")


def warc_roundtrip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, raw_path: str | None = None, path: str | None = None
) -> DataFrame:
    """Archive every page, resolve revisits, and read the result back.

    One row per input row: the id (in its own type), url, payload_bytes,
    payload_digest, record_type (response or revisit) and refers_to (the
    response's id, for revisits).  The payload is the html in UTF-8, null: empty.
    Repeated rows are records of their own, so all but one revisit; line ends in
    a url become blanks; ids are kept as text in the archives; a null id comes
    back null and is the last to be a response; ties in ids go to the least
    record id; a very long page is held whole by one task; other columns are not
    read, whatever their names; an empty table gives no rows.  Archives are
    written when this is called; those under ``raw_path`` and ``path`` stay, if
    those are given, which must be new folders."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    raw, out = raw_path or work_folder(spark), path or work_folder(spark)
    capture(pages, raw, id_col, url_col, html_col)
    resolve_revisits(spark, raw, out, min_bytes, kind)
    back = read_archives(spark, out)
    return back.select(
        F.col("page_id").cast(kind).alias(id_col), F.col("uri").alias(url_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
