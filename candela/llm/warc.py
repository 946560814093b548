"""WARC archives without repeated payloads: revisit records resolved over a shuffle of headers by payload digest."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import fresh_path, materialize, pieces, ship, table, text_of

#: Smaller payloads are stored each time: a revisit record would hardly be shorter.
LEAST_BYTES = 1000
#: Copies of a repeated payload's entry, so that its many records are looked up in so many tasks.
SALTS = 16
#: What ends a record, and what the text writer puts at the end of a file.
GAP, PAD = "\r\n\r\n", "\0"
#: Bytes of an archive file, about.
FILE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def resolved(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The rows of ``pages`` with ``payload, digest, refers_to``: the id of the response that the row revisits, or null.

    Only digests, size and id of a page are shuffled to find the responses; then each row moves once, to its entry if it has
    one. Payloads are equal if SHA-1, SHA-256 and size are: clashes of SHA-1 alone are public and may stand on any page.
    """
    rows = pages.withColumn("payload", text_of(html_col)).withColumns(
        {"digest": F.sha1(text_of(html_col)), "strong": F.unhex(F.sha2(text_of(html_col), 256)), "size": F.octet_length(text_of(html_col)).cast("long")}
    )
    same = ["digest", "strong", "size"]
    large = rows.where(F.col("size") >= least_bytes).select(*same, F.col(id_col).alias("refers_to"))
    salted = large.groupBy(*same, F.pmod(F.xxhash64("refers_to"), F.lit(SALTS)).alias("salt"))
    salted = salted.agg(F.max("refers_to").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    repeated = salted.groupBy(*same).agg(F.max("refers_to").alias("refers_to"), F.sum("n").alias("n")).where("n > 1").drop("n")
    repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(repeated, [*same, "salt"], "left")
    return rows.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("refers_to")), F.col("refers_to"))).drop("salt", "strong")


def _name(page: object) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _record(kind: str, uri: str, date: str, page: object, block: str, more: list[tuple[str, str]]) -> str:
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", _name(page)), ("WARC-Date", date), *([("WARC-Target-URI", uri)] if uri else []), *more,
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block.encode()))),
    ]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + block


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES,
    date: datetime | None = None, compression: str | None = "gzip", file_bytes: int = FILE_BYTES,
) -> None:
    """Write one WARC/1.1 record per row below ``path``: a response with its payload, or a revisit of the response that has it.

    Payloads are the html in UTF-8, null being empty. Of equal payloads of ``least_bytes`` or more the largest page id is
    the response; rows that repeat this id are responses as well. Headers are fresh: own record ids, digests (SHA-1, base 16),
    date and lengths; rows that repeat a page id repeat its record id. Control characters and spaces of a URL are
    percent-encoded, a null URL leaves its field out, a null page id an empty name. Other columns are ignored. An empty table
    gives an archive without records.

    A file ends after about ``file_bytes``, a page of any length being one record. With ``gzip`` each record is a member of
    its own, so that readers can seek to it. Spark's text writer commits the files, a file being one row, so a lost executor
    leaves neither half a file nor a second copy; the byte that the writer puts at a file's end is padding.
    """
    ship(pages.sparkSession)
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = resolved(pages.select(F.col(id_col), F.col(url_col), F.col(html_col)), id_col=id_col, html_col=html_col, least_bytes=least_bytes)
    rows = rows.select(
        F.col(id_col).alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), "digest", "size", "refers_to",
        F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("").alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for whole in batches:
            for batch in pieces(whole, "payload"):
                for r in batch.to_pylist():
                    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", r["url"])
                    digest = [("WARC-Payload-Digest", f"sha1:{r['digest']}")]
                    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    if r["refers_to"] is None:
                        record = _record("response", uri, stamp, r["page"], f"{head}Content-Length: {r['size']}\r\n\r\n{r['payload']}", digest)
                    else:
                        more = [("WARC-Refers-To", _name(r["refers_to"])), ("WARC-Profile", PROFILE), *digest]
                        record = _record("revisit", uri, stamp, r["page"], f"{head}Content-Length: 0\r\n\r\n", more)
                    data = (record + GAP).encode()
                    if compression:
                        data = gzip.compress(data, mtime=0)
                    if held and size + len(data) > file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])
                        held, size = [], 0
                    held.append(data)
                    size += len(data)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])

    files = rows.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", PAD).option("maxRecordsPerFile", 1).text(path)


def _parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of a file; only Content-Length says where a block ends."""
    at = 0
    while at < len(content) and content[at : at + 1] != PAD.encode():
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts at byte {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, content[start:at]
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} doesn't end")
        at += 4


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file, unpacked one after another where they are gzip members."""
    if content[:2] != b"\x1f\x8b":
        yield from _parsed(content)
        return
    at = 0
    while at < len(content) and content[at] != 0:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            fed = content[at : at + (1 << 16)]
            if not fed:
                raise ValueError("the last record is cut short")
            parts.append(member.decompress(fed))
            at += len(fed) - len(member.unused_data)
        yield from _parsed(b"".join(parts))


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Read archives back: ``page_id, record_type, refers_to, url, payload_digest, payload`` (a revisit's payload is null)."""
    import hashlib

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "url", "payload_digest", "payload"]
        kinds = [pa.string()] * 5 + [pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                out: list[tuple] = []
                held = 0
                for fields, block in _records(data):
                    page, refers = ((fields.get(k, "")[10:-1] or None) for k in ("warc-record-id", "warc-refers-to"))
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if fields["warc-type"] == "response" else None
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of page {page} doesn't match its digest")
                    out.append((page, fields["warc-type"], refers, fields.get("warc-target-uri"), digest, payload))
                    held += len(payload or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    kind = "page_id string, record_type string, refers_to string, url string, payload_digest string, payload binary"
    return files.mapInArrow(run, kind).withColumns({x: F.col(x).cast(id_type) for x in ("page_id", "refers_to")})


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path)
    records = materialize(read.withColumn("bytes", F.octet_length("payload").cast("long")).drop("payload", "url"), "warc-records")
    # A revisit's payload is that of the response which it refers to; few are referred to, each by any number of revisits.
    revisits = records.where("record_type = 'revisit'")
    referred = revisits.select(F.col("refers_to").alias("page_id")).distinct()
    sizes = records.where("record_type = 'response'").join(referred, "page_id").groupBy("page_id").agg(F.max("bytes").alias("payload_bytes"))
    spread = sizes.select(F.col("page_id").alias("refers_to"), "payload_bytes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["refers_to", "salt"], "left")
    whole = records.where("record_type = 'response'").withColumnRenamed("bytes", "payload_bytes").unionByName(found.drop("bytes", "salt"))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH rows AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
    FROM pages
)
SELECT page_id,
       bytes AS payload_bytes,
       sha1(html) AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM rows
"""
