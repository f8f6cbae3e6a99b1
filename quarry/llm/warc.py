"""WARC archives with revisit resolution.

``write_archives`` shuffles the records' headers by payload digest, finds the
response of every payload (its least id), and writes each record to archives
of one gzip member per record: the response with its payload, every other
record as a *revisit* (identical-payload-digest profile) with fresh headers
that refer to the response.  ``read_archives`` reads headers and payloads
back, shuffles the headers by digest again and joins the revisits to their
responses.

A hot payload's copies carry no state: the response is a grouped minimum
(combined before the shuffle) and the joins are on staged tables, so Spark
splits a hot digest's rows.  Files are named by task attempt and listed in a
manifest, so a retried task can't mix two attempts' records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Output, attempt_name, read_file, shuffle_width, small_batches, staged, text_or_empty
from quarry.session import scratch_path

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 0  # payloads of fewer bytes are always written out
FILE_BYTES = 64 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"  # of records without a date; fixed, so reruns agree


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 8 groups of 5 hex digits, 4 letters each."""
    code = F.sha1(payload)
    group = lambda i: F.conv(F.substring(code, 1 + 5 * i, 5), 16, 10).cast("int")
    letter = lambda n, k: F.substring(F.lit(ALPHABET), F.shiftright(n, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[letter(group(i), k) for i in range(8) for k in range(4)])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", DATE)]
        return _record(fields, http)
    return _record(fields, http + payload)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive of
    gzip members; a plain archive is read as one member."""
    at = 0
    while at < len(data):
        if data[at: at + 2] == b"\x1f\x8b":
            member = zlib.decompressobj(wbits=31)
            raw = member.decompress(data[at:at + (1 << 16)])
            read = min(len(data), at + (1 << 16))
            while not member.eof and read < len(data):
                raw += member.decompress(data[read:read + (1 << 16)])
                read = min(len(data), read + (1 << 16))
            at = read - len(member.unused_data)
        else:
            raw, at = data[at:], len(data)
        pos = 0
        while pos < len(raw):
            end = raw.index(b"\r\n\r\n", pos)
            lines = raw[pos:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(heads["content-length"])
            yield heads, raw[end + 4: end + 4 + size]
            pos = end + 4 + size + 4


def resolve(headers: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(digest, _first): the least id of every payload of ``least`` bytes or
    more that has several ids; null ids count as greatest."""
    groups = headers.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("_first"), F.max("page_id").alias("_last"), F.bool_or(F.col("page_id").isNull()).alias("_null"))
    several = (F.col("_first") < F.col("_last")) | (F.col("_null") & F.col("_first").isNotNull())
    return staged(groups.filter(several).select(F.col("payload_digest").alias("_digest"), "_first"), "warc-firsts")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row to gzip archives under ``folder`` and return
    their manifest (file, records, bytes).

    A null html is the empty payload.  Of equal payloads the record with the
    least id is the response; rows that share that id are all responses (a
    record can't revisit itself), and if all ids are null, all are.  A null
    url is left out of the headers.  An empty table writes no file."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    payload = F.encode("html", "UTF-8")
    rows = rows.withColumn("payload_digest", base32_sha1(payload)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    firsts = resolve(rows.select("page_id", "payload_digest", "payload_bytes"), least)
    joined = rows.join(firsts, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    records = joined.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "payload_digest",
                            F.col("_first").alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, n, name = [], None, 0, attempt_name()
        for b in small_batches(batches, "html"):
            for r in b.to_pylist():
                if out is None:
                    out, n = Output(folder, f"pages-{name}-{len(done):05d}.warc.gz"), 0
                out.write(gzip.compress(build_record(r["page_id"], r["url"], r["html"].encode(), r["payload_digest"], r["refers_to"], r["revisit"]), 6, mtime=0))
                n += 1
                if out.n >= file_bytes:
                    out.close()
                    done.append((out.path, n, out.n))
                    out = None
        if out is not None:
            out.close()
            done.append((out.path, n, out.n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())], ["file", "records", "bytes"])

    return staged(records.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest
    (both of the full payload), record_type, refers_to (the response's
    page_id of a revisit), url."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                rows = []
                for heads, block in parse_records(read_file(file)):
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, said = heads["warc-type"], heads["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != said:
                        raise ValueError(f"{file}: a payload doesn't match its digest")
                    page = heads.get("x-page-id")
                    rows.append((None if page is None else int(page), heads.get("warc-target-uri"), kind, said, len(payload) if kind == "response" else None,
                                 heads["warc-record-id"], heads.get("warc-refers-to")))
                names = ["page_id", "url", "record_type", "payload_digest", "bytes", "record", "refers"]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    files = manifest.select("file").repartition(shuffle_width(manifest.sparkSession))
    records = staged(files.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, bytes long, record string, refers string"), "warc-records")
    revisits = records.filter("record_type = 'revisit'")
    wanted = staged(revisits.select(F.col("refers").alias("_refers")).distinct(), "warc-referred")
    responses = records.filter("record_type = 'response'").join(wanted, F.col("record") == F.col("_refers"), "left_semi")
    responses = staged(responses.groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.max("bytes").alias("_bytes")), "warc-responses")
    found = revisits.join(responses, F.col("payload_digest") == F.col("_digest"), "left")
    out = lambda df, size, to: df.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", to.alias("refers_to"), "url")
    return out(records.filter("record_type = 'response'"), F.col("bytes"), F.lit(None).cast("long")).unionAll(out(found, F.col("_bytes"), F.col("_first")))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archives under the shared folder and read them back."""
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "llm", "warc"), **options))
