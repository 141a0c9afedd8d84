"""Operator 8: WARC archives, index first.

Writing: every task writes archives of records that are gzip members of their own and returns one index
row for each record: file, offset, length, URL, digest.  The index is a table written when all archives are there;
a task that is run again writes files of new names, and only those of the task that succeeded are in the index.
Reading starts from the index: selected records are sorted by file and offset, and neighbouring byte ranges are read
at once.

Archives lie in the shared folder; Python reads and writes there through Arrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Maybe, fresh_path, only, small_batches, stage

#: Fixed value: the profile of revisits with identical payloads in WARC 1.1.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 256_000_000
RANGE_BYTES = 8_000_000
GAP_BYTES = 64_000
INDEX = pa.schema(
    [
        ("page_id", pa.int64()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("url", pa.string()),
        ("digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)
INDEX_DDL = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{_name(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:uuid:{_name(refers_to)}>"]
    block = http + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def information(file: str, date: str) -> bytes:
    """The record that opens an archive and describes it; no index row points to it."""
    block = b"software: lodestack\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _name(page_id: int | None) -> uuid.UUID:
    return uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f"page {page_id}")


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if re.match("file:/+", path):
        path = "/" + re.sub("^file:/+", "", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the index.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is a response
    and the others revisit it; smaller ones are all responses.
    """
    spark = pages.sparkSession
    small_batches(spark)
    text = F.coalesce("html", F.lit(""))
    rows = only(pages, "page_id", "url", "html").select("page_id", "url", text.alias("html"), F.sha1(F.encode(text, "UTF-8")).alias("sha"), F.octet_length(text).alias("bytes"))
    # Payloads stay out of the search for equal ones; the first pages are dealt out anew, so that a common payload's rows can be split.
    slim = rows.where(f"bytes >= {least_bytes}").select("page_id", "sha")
    firsts = slim.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").select(F.col("sha").alias("s"), "first").hint("rebalance")
    # Rows that share the smallest id cannot be told apart, so each is a response.
    again = slim.join(firsts, F.col("sha") == F.col("s")).where("not page_id <=> first").select(F.xxhash64("page_id", "sha").alias("k"), F.col("page_id").alias("p"), "s", "first").distinct()
    again = stage(again, "revisits")
    known = rows.withColumn("k_", F.xxhash64("page_id", "sha"))
    maybe = Maybe(again.select("k"))
    new = maybe.beside(known, "k_").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    old = maybe.of(known, "k_").join(again, (F.col("k_") == F.col("k")) & F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    typed = new.unionByName(old.select("page_id", "url", "html", F.col("first").alias("refers_to")))
    folder = fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _file_system(folder)
        store.create_dir(top, recursive=True)
        out, at, name = None, 0, ""
        for b in batches:
            index = []
            for r in b.to_pylist():
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{top}/{name.rpartition('/')[2]}", compression=None)
                    about = information(name.rpartition("/")[2], date)
                    out.write(about)
                    at = len(about)
                payload = r["html"].encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                member = record(r["page_id"], r["url"], payload, digest, r["refers_to"], date)
                out.write(member)
                kind = "response" if r["refers_to"] is None else "revisit"
                index.append([r["page_id"], name, at, len(member), r["url"], digest, kind, r["refers_to"]])
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), INDEX.types)], schema=INDEX)
        if out is not None:
            out.close()

    return stage(typed.mapInArrow(run, INDEX_DDL), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """The records of index rows: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    The payload of a revisit is null; its length and digest are those its record states.  A response whose payload
    does not have the stated digest raises an error, and so does a record whose name, kind or reference is not the index's.
    """
    columns = ["page_id", "file", "offset", "length", "refers_to"]
    width = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chosen = index.select(*columns).repartitionByRange(width, "file", "offset").sortWithinPartitions("file", "offset")

    def ranges(rows: Iterator[dict]) -> Iterator[list[dict]]:
        """Rows whose bytes are read at once."""
        held: list[dict] = []
        for r in rows:
            if held and (
                r["file"] != held[0]["file"]
                or r["offset"] - held[-1]["offset"] - held[-1]["length"] > GAP_BYTES
                or r["offset"] + r["length"] - held[0]["offset"] > RANGE_BYTES
            ):
                yield held
                held = []
            held.append(r)
        if held:
            yield held

    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = "", None
        for group in ranges(r for b in batches for r in b.to_pylist()):
            if group[0]["file"] != opened:
                store, path = _file_system(group[0]["file"])
                opened, source = group[0]["file"], store.open_input_file(path)
            begin = group[0]["offset"]
            end = max(r["offset"] + r["length"] for r in group)
            data = source.read_at(end - begin, begin)
            out = []
            for r in group:
                warc, http, payload = parse(data[r["offset"] - begin : r["offset"] - begin + r["length"]])
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                response = warc["warc-type"] == "response"
                if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{opened} at {r['offset']}: the payload is not what its digest says")
                told = {"warc-record-id": r["page_id"], "warc-refers-to": r["refers_to"]}
                if any(i is not None and warc.get(h) != f"<urn:uuid:{_name(i)}>" for h, i in told.items()) or response != (r["refers_to"] is None):
                    raise ValueError(f"{opened} at {r['offset']}: the record is not what the index says")
                size = len(payload) if response else int(http["content-length"])
                out.append([r["page_id"], warc.get("warc-target-uri"), warc["warc-type"], r["refers_to"], size, digest, payload if response else None])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return chosen.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages, read all back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null html counts as empty and null URLs are left out of the record.  Rows with a null page_id are written like
    others, but nothing refers to them.  Repeated rows of the smallest page_id are all responses.  An empty table gives
    no rows.  Other columns are not read.
    """
    return read_archives(write_archives(pages, least_bytes)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
