"""WARC archives with content-addressed payloads.

Payloads are addressed by their SHA-256 and length; a payload's bytes stand in
the archive once, in a response record, and later copies are revisit records
that name it. Record headers are kept exactly, apart from the payloads: reading
gives a table of records (headers, digests, place) and a table of payloads
(address, bytes), and reconstruct() joins the two into the original records.
Digests are verified when archives are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches
from .files import filesystem, new_file

CRLF = b"\r\n"
#: A fixed date: archives of equal pages are equal, byte for byte.
DATE = "2020-01-01T00:00:00Z"
#: Each record is a gzip member of its own, so that it can be read from its offset alone.
LEVEL = 4
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line; what would end the line is percent-encoded."""
    return re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", value)


def _restore(value: str) -> str:
    return re.sub(r"%(0A|0D|25)", lambda m: chr(int(m[1], 16)), value)


def record_headers(page_id: str, url: str | None, kind: str, payload_digest: str, address: str, size: int, refers_to: str | None, block: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:veinmap:page:{_clean(page_id)}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-SHA256: {address}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:veinmap:page:{_clean(refers_to)}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {block}"]
    return CRLF.join(x.encode() for x in lines) + CRLF + CRLF


def _writer(folder: str):
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        path, n = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "address", "size", "refers_to", "revisit", "payload"))))
        first = next(rows, None)
        if first is None:
            return
        with new_file(path) as out:
            while first is not None:
                page_id, url, address, size, refers_to, revisit, payload = first
                body = b"" if revisit else payload or b""
                digest = base32_sha1(payload or b"")
                head = record_headers("null" if page_id is None else str(page_id), url, "revisit" if revisit else "response", digest, address, size, "null" if refers_to is None else str(refers_to), len(body))
                out.write(gzip.compress(head + body + CRLF + CRLF, LEVEL, mtime=0))
                n += 1
                first = next(rows, None)
        yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([n], pa.int64())})

    return write


def write_archive(pages: DataFrame, folder: str | None = None, least_revisit: int = 0) -> list[tuple[str, int]]:
    """Write a record per row of pages (page_id, url, html) and return (path, records) of each file.

    Among rows of equal payload of least_revisit bytes or more, the one with the
    largest page_id (null ids are the smallest) is the response and the others
    revisit it; of rows that repeat that page_id one is the response. A null html
    is an empty payload. A null id is written, and read back, as null. An empty
    table writes no file.
    """
    small_batches(pages.sparkSession)
    folder = folder or scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.monotonically_increasing_id().alias("row"), payload.alias("payload")).withColumn("size", F.length("payload").cast("long")).withColumn("address", F.sha2("payload", 256))
    winners = rows.filter(F.col("size") >= least_revisit).groupBy("address", "size").agg(F.max(F.struct("page_id", "row")).alias("w"), F.count("*").alias("copies")).filter("copies > 1").select(F.col("address").alias("w_address"), F.col("size").alias("w_size"), "w")
    marked = rows.join(winners, (F.col("address") == F.col("w_address")) & (F.col("size") == F.col("w_size")), "left")
    revisit = F.coalesce(F.col("row") != F.col("w.row"), F.lit(False))
    ready = marked.select("page_id", "url", "address", "size", F.when(revisit, F.col("w.page_id")).alias("refers_to"), revisit.alias("revisit"), "payload")
    return [tuple(r) for r in ready.mapInArrow(_writer(folder), "path string, records long").collect()]  # one row per file


def _members(stream, piece: int = 1 << 20):
    """(offset, content) of each gzip member of a stream."""
    held, offset = stream.read(piece), 0
    while held:
        inflate, content, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not held and not (held := stream.read(piece)):
                raise ValueError("the archive ends inside a record")
            content.append(inflate.decompress(held))
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        yield offset, b"".join(content)
        offset += used
        held = held or stream.read(piece)


def records_of(stream):
    """(offset, exact header bytes, headers, block) of each record of an archive."""
    for offset, record in _members(stream):
        end = record.find(CRLF + CRLF) + 4
        lines = record[: end - 4].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        if lines[0] != "WARC/1.1" or end + int(headers["Content-Length"]) + 4 != len(record) or record[-4:] != CRLF + CRLF:
            raise ValueError(f"the record at {offset} is damaged")
        yield offset, record[:end], headers, record[end:-4]


RECORDS = "page_id string, url string, record_type string, payload_digest string, address string, payload_bytes long, refers_to string, headers binary, path string, offset long"


def _page(value: str) -> str:
    return _restore(re.fullmatch(r"<urn:veinmap:page:(.*)>", value)[1])


def _reader(with_payload: bool):
    def read(batches):
        import pyarrow as pa

        def flush(rows):
            names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
            kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
            types = [kinds[x.split()[1]] for x in RECORDS.split(", ")] + [pa.binary()] * with_payload
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for offset, head, h, block in records_of(stream):
                        kind = h["WARC-Type"]
                        address, digest, size = h["X-Payload-SHA256"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        if kind == "response" and (len(block) != size or hashlib.sha256(block).hexdigest() != address or base32_sha1(block) != digest):
                            raise ValueError(f"{path} at {offset}: the payload does not match its digests")
                        if with_payload and kind != "response":
                            continue
                        page_id = _page(h["WARC-Record-ID"])
                        row = (None if page_id == "null" else page_id, _restore(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None, kind, digest, address, size, _page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, head, path, offset)
                        row = (*row[:6], None if row[6] == "null" else row[6], *row[7:])
                        rows.append((*row, block) if with_payload else row)
                        held += len(block) * with_payload + len(head)
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    return read


def _over(spark: SparkSession, files: list[tuple[str, int]], with_payload: bool) -> DataFrame:
    schema = RECORDS + ", payload binary" * with_payload
    if not files:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(p,) for p, _ in files], "path string").repartition(len(files)).mapInArrow(_reader(with_payload), schema)


def read_records(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """The records of archives, headers exactly as written, without payloads."""
    return _over(spark, files, False)


def read_payloads(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(address, payload_bytes, payload): each stored payload once."""
    return _over(spark, files, True).select("address", "payload_bytes", "payload").dropDuplicates(["address", "payload_bytes"])


def resolved(records: DataFrame) -> DataFrame:
    """records with each revisit's digest and size held against the stored response of its address; one without, or with another digest, fails the query.

    Responses are verified against their own payloads when they are read.
    """
    stored = records.filter("record_type = 'response'").groupBy(F.col("address").alias("s_address"), F.col("payload_bytes").alias("s_bytes")).agg(F.min("payload_digest").alias("s_digest"))
    joined = records.join(stored, (F.col("address") == F.col("s_address")) & (F.col("payload_bytes") == F.col("s_bytes")), "left")
    right = F.col("payload_digest").eqNullSafe(F.col("s_digest"))
    fail = F.raise_error(F.concat(F.lit("no stored payload of this digest at "), F.col("address"))).cast("string")
    return joined.withColumn("payload_digest", F.when(right, F.col("s_digest")).otherwise(fail)).select(records.columns)


def reconstruct(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """Original records: page_id, url, headers and the full payload, revisits included."""
    return read_records(spark, files).join(read_payloads(spark, files), ["address", "payload_bytes"]).select("page_id", "url", "headers", "payload")


#: DuckDB has no base32: five bits at a time from the digest's hex digits as binary ones.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
s AS (SELECT *, CAST(strlen(t) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(40), lambda k: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(sha1(t), CAST(k + 1 AS INT), 1))]), '') AS bits, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda b: CASE WHEN substr(bits, CAST(5 * k + b + 1 AS INT), 1) = '1' THEN (16 // CAST(2 ** b AS INT)) ELSE 0 END)) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM s
"""
