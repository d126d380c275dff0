"""WARC archives: written with an index, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import hot_cold_join, release, work_path, written

#: Payloads shorter than this are always written in full.
MIN_BYTES = 0
#: Bytes after which a task begins another archive; the longest range read at once; the longest gap read along.
ARCHIVE_BYTES, RANGE_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes of one archive that a reading task gets together.
READ_BYTES = 32 << 20
INDEX = "id long, url string, type string, digest string, refers_to long, file string, offset long, length long"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, str]:
    """One record as a gzip member, and the payload's digest. A revisit has HTTP headers only."""
    digest = sha1_32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:none"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Block-Digest: sha1:{sha1_32(block)}", "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page is None else page}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush(), digest


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member; a wrong length or digest is an error."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    warc = dict(x.partition(": ")[::2] for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or warc["WARC-Block-Digest"] != f"sha1:{sha1_32(block)}":
        raise ValueError(f"damaged record {warc['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.partition(": ")[::2] for x in http.decode().split("\r\n")[1:]), payload


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of df to archives under path; returns their index (id, url, type, digest, refers_to, file, offset, length).

    Of rows with equal payloads of min_bytes or more, that with the smallest id is a response and the others are
    revisits of it; rows that tie on the smallest id, rows with a null id and shorter payloads are all responses.
    A null payload is empty, a null url `urn:none`. The index is written last; archives of lost task attempts are
    not in it. Equality is by SHA-256 and length; a payload that fills a third of the rows stays where it is read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.concat(F.sha2("payload", 256), F.lit(":"), F.octet_length("payload")))
    first = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    rows = hot_cold_join(rows, written(first, "repeated"), ["same"], "k", "left").select("id", "url", "payload", F.when(F.col("first") < F.col("id"), F.col("first")).alias("refers_to"))

    def write(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data, digest = record(page, url, payload, refers, refers is not None, date)
                    out.write(data)
                    index.append((page, url, "response" if refers is None else "revisit", digest, refers, f"{path}/{name}", at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["id", "url", "type", "digest", "refers_to", "file", "offset", "length"]) if index else pa.RecordBatch.from_pylist([], schema=pa.schema([("id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if out is not None:
                out.close()
        release()

    return written(rows.mapInArrow(write, INDEX), "index")


def ranges(records: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Coalesces (offset, length) in order into (start, end, first record, last record + 1) byte ranges."""
    out: list[tuple[int, int, int, int]] = []
    for i, (at, n) in enumerate(records):
        if out and at - out[-1][1] <= GAP_BYTES and at + n - out[-1][0] <= RANGE_BYTES:
            out[-1] = (out[-1][0], max(out[-1][1], at + n), out[-1][2], i + 1)
        else:
            out.append((at, at + n, i, i + 1))
    return out


def read_warc(index: DataFrame) -> DataFrame:
    """The records that the index rows point to: id, type, refers_to, digest, payload_bytes, payload (null for revisits).

    Index rows are dealt out by archive and stretch of READ_BYTES, as many tasks as the archives' size asks for, and
    sorted by offset; each run of neighbours is one read. A response's payload
    must have the digest of its header. payload_bytes of a revisit is that of the payload it stands for.
    """

    def read(batches):
        for batch in batches:
            files, at, length = (c.to_pylist() for c in batch.columns)
            out, i = [], 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                store, name = fs.FileSystem.from_uri(files[i])
                with store.open_input_file(name) as f:
                    for a, b, p, q in ranges(list(zip(at[i:j], length[i:j], strict=True))):
                        data = f.read_at(b - a, a)
                        for k in range(i + p, i + q):
                            warc, http, payload = parse(data[at[k] - a : at[k] - a + length[k]])
                            digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                            if kind == "response" and sha1_32(payload) != digest:
                                raise ValueError(f"damaged payload in {files[i]}")
                            page, refers = warc["X-Page-ID"], warc.get("X-Refers-To-Page")
                            out.append((int(page) if page else None, kind, int(refers) if refers else None, digest, int(http["Content-Length"]), payload if kind == "response" else None))
                        if sum(len(x[5] or b"") for x in out) > RANGE_BYTES:
                            yield _batch(out)
                            out = []
                i = j
            yield _batch(out)

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-int(size) // READ_BYTES))
    rows = index.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return rows.mapInArrow(read, "id long, type string, refers_to long, digest string, payload_bytes long, payload binary")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    types = (("id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()))
    cols = list(zip(*out, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[n for n, _ in types])


def op2_warc(spark, sf_dir: str) -> DataFrame:
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), work_path(spark, "warc"))
    rows = read_warc(index)
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(k // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - k % 4 * 5 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""
