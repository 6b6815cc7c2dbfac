"""WARC archives: a writer (one gzip member per record) and a sequential reader.

The reader inflates incrementally, so a record's size, not the archive's, bounds its memory. It
frames records by content length and recomputes the digests that the headers claim, in hex or base32, so
archives of other writers can be read too; records that are neither responses nor revisits are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach, fresh_path, stored

#: Records of one archive end when it has so many compressed bytes.
ROTATE_BYTES = 64 << 20
#: Payloads shorter than this are always stored as responses.
REVISIT_LEAST = 100
READ_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = "2020-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    """An archive that isn't well formed."""


def record_id(page_id: int | None) -> str:
    """A page's record; one without an id gets a name of its own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def qualified(spark: SparkSession, path: Column) -> Column:
    """Paths with the scheme that Spark would give them: where they name none, the default file system and its working folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(".")
    here = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    root = f"{here.getScheme()}://{here.getAuthority() or ''}"
    return F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), path).when(path.startswith("/"), F.concat(F.lit(root), path)).otherwise(F.concat(F.lit(f"{root}{here.getPath().rstrip('/')}/"), path))


def open_shared(uri: str, mode: str) -> BinaryIO:
    """A file of the shared folder, by its scheme: the local one directly, others through Arrow."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(at.path), exist_ok=True)
        return open(at.path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if "w" in mode:
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_stream(path)


def remove_folder(uri: str) -> None:
    """A folder of the shared folder and what is in it."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        shutil.rmtree(at.path, ignore_errors=True)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.delete_dir(path)


def encode_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that points to the response."""
    block = HTTP_HEAD if refers_to is not None else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {STAMP}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode()) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member an iterator of its inflated pieces; each must be used up before the next."""
    rest = stream.read(READ_BYTES)
    while rest:
        box = [rest]

        def pieces(box: list[bytes] = box) -> Iterator[bytes]:
            inflate, data = zlib.decompressobj(31), box[0]
            while True:
                out = inflate.decompress(data, READ_BYTES)
                if out:
                    yield out
                if inflate.eof:
                    box[0] = inflate.unused_data or stream.read(READ_BYTES)
                    return
                data = inflate.unconsumed_tail or stream.read(READ_BYTES)
                if not data and not out:
                    raise WarcError("a gzip member ends early")

        yield pieces()
        rest = box[0]


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytearray]]:
    """(headers with lower-case names, block) of each record, framed by its content length; a block is held once."""
    for member in members(stream):
        head = bytearray()
        while (end := head.find(b"\r\n\r\n")) < 0:
            piece = next(member, None)
            if piece is None:
                raise WarcError("a record has no end of headers")
            head += piece
        lines = bytes(head[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"not a WARC version line: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not headers.get("content-length", "").isdigit():
            raise WarcError("a record has no content length")
        need = int(headers["content-length"])
        body = head
        del body[: end + 4]
        for piece in member:
            body += piece
            if len(body) > need + 4:
                raise WarcError("a record is longer than its content length")
        if len(body) != need + 4 or body[need:] != b"\r\n\r\n":
            raise WarcError("a record isn't as long as its content length")
        del body[need:]
        yield headers, body


def check_digest(claimed: str | None, data: memoryview, what: str) -> None:
    """Raises where data hasn't the digest that a header claims ("sha1:BASE32" or "sha256:hex"); unknown algorithms claim nothing."""
    name, _, value = (claimed or "").partition(":")
    name = name.lower().replace("-", "")
    if not value or name not in hashlib.algorithms_available:
        return
    made = hashlib.new(name, data)
    if value.lower() != made.hexdigest() and value.upper().rstrip("=") != base64.b32encode(made.digest()).decode().rstrip("="):
        raise WarcError(what)


def verified(headers: dict[str, str], block: bytearray, payloads: bool = False) -> dict | None:
    """The row of a response or revisit, None for other records; raises where a digest that can be recomputed is wrong.

    A revisit has no payload: its digest is the one that it claims, its length is its response's and null here.
    """
    view, kind, name = memoryview(block), headers.get("warc-type"), headers.get("warc-record-id", "")
    check_digest(headers.get("warc-block-digest"), view, f"block digest of {name}")
    if kind not in ("response", "revisit"):
        return None
    # what isn't HTTP is all payload
    at = block.find(b"\r\n\r\n") + 4 if headers.get("content-type", "").startswith("application/http") else 0
    payload = view[at if at > 3 else 0 :]
    claimed = headers.get("warc-payload-digest")
    whole = kind == "response"
    if whole:
        check_digest(claimed, payload, f"payload digest of {name}")
    number = lambda key: int(headers[key]) if headers.get(key, "").lstrip("-").isdigit() else None
    return {
        "page_id": number("x-page-id"), "payload_bytes": len(payload) if whole else None, "payload_digest": hashlib.sha256(payload).hexdigest() if whole else (claimed or "").partition(":")[2] or None,
        "record_type": kind, "refers_to": number("x-refers-to-page"), "url": headers.get("warc-target-uri"),
        "payload": bytes(payload).decode("utf-8", "replace") if whole and payloads else None,
    }


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """pages with _digest, and in _refers_to the page whose response a revisit points to. A row without an id is always a response, and none refers to it."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    marked = pages.withColumn("_digest", F.sha2(payload, 256)).withColumn("_bytes", F.octet_length(payload))
    groups = marked.where(F.col("_bytes") >= REVISIT_LEAST).groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    groups = stored(groups)
    total = groups.agg(F.sum("_copies")).first()[0] or 0
    planned = attach(marked, groups, "_digest", "_copies", total, F.col(id_col))
    return planned.withColumn("_refers_to", F.when(F.col("_first") < F.col(id_col), F.col("_first"))).drop("_first", "_copies", "_bytes")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes every row of pages as a record; returns the manifest (path, records), already stored.

    Each attempt of a task writes files of its own name and only those that the manifest names
    count, so a retried or speculative task can't double a record. Null payloads are empty, null
    URLs are written as about:blank, a null id is left out. Rows repeated with one id and payload are each a response.
    Empty tables write nothing; extra columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, path, n, size = TaskContext.get(), None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):03d}.warc.gz"
                    out = open_shared(path, "wb")
                size += out.write(encode_record(page.as_py(), url.as_py() or "about:blank", (html.as_py() or "").encode("utf-8"), digest.as_py(), refers.as_py()))
                n += 1
                if size >= ROTATE_BYTES:
                    out.close()
                    done.append((path, n))
                    out, n, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([k for _, k in done], pa.int64())})

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("html"))
    rows = plan_records(own).select("page_id", "url", "html", "_digest", "_refers_to")
    return stored(rows.mapInArrow(write, "path string, records long"))


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per response or revisit of the archives that the manifest (path, records) names, digests verified.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url and, where asked
    for, payload (null for revisits). Page ids and what refers to them are null where the writer gave none, payload_bytes for
    revisits. A broken archive raises WarcError, as does one with other than ``records`` rows (null: not known).
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), *([("payload", pa.string())] if payloads else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with open_shared(path, "rb") as stream:
                    for headers, block in read_records(stream):
                        row = verified(headers, block, payloads)
                        if row is None:
                            continue
                        rows.append(row)
                        seen, held = seen + 1, held + len(block)
                        if len(rows) >= 5000 or payloads and held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)
                            rows, held = [], 0
                if expected is not None and seen != expected:
                    raise WarcError(f"{path} has {seen} records; {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    n = max(1, min(manifest.count(), 100_000))
    spread = manifest.select(qualified(manifest.sparkSession, F.col("path")).alias("path"), "records").repartition(n, F.col("path"))
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload string" if payloads else "")
    return spread.mapInArrow(read, kinds)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with every revisit's length and digest taken from the response that it refers to; raises where their digests differ or there is none."""
    # two payloads may lie under one page id, so a revisit's response is the one with its id and its digest
    key = lambda page: F.concat_ws(":", F.col(page).cast("string"), F.lower("payload_digest"))
    keyed = records.withColumn("_key", F.when(F.col("record_type") == "revisit", key("refers_to")))
    wanted = keyed.where("record_type = 'revisit'").groupBy("_key").agg(F.count("*").alias("_times"))
    found = records.where("record_type = 'response'").select(key("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.lower("payload_digest").alias("_digest"))
    responses = stored(wanted.join(found, F.col("_key") == F.col("_page")).groupBy("_key").agg(F.max("_times").alias("_times"), F.max("_bytes").alias("_bytes"), F.max("_digest").alias("_digest")))
    total = responses.agg(F.sum("_times")).first()[0] or 0
    joined = attach(keyed, responses, "_key", "_times", total, F.coalesce("page_id", F.lit(0)))
    right = F.coalesce(F.lower("payload_digest") == F.col("_digest"), F.lit(False))
    checked = F.when(right, F.col("_digest")).otherwise(F.raise_error(F.concat(F.lit("no response of a revisit's digest: page "), F.col("page_id").cast("string"))).cast("string"))
    revisit = F.col("record_type") == "revisit"
    done = {"payload_digest": F.when(revisit, checked).otherwise(F.col("payload_digest")), "payload_bytes": F.when(revisit, F.col("_bytes")).otherwise(F.col("payload_bytes"))}
    return joined.select(*[done[c].alias(c) if c in done else F.col(c) for c in records.columns])


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages to archives and reads them back, one row per page; archives without a ``folder`` of their own are removed when read."""
    at = folder or fresh_path(pages.sparkSession, "warc")
    records = stored(read_archives(write_archives(pages, at, id_col, url_col, payload_col)))
    if folder is None:
        remove_folder(at)
    return resolve_revisits(records)
