"""Operator 8: WARC archives, index first.

Writing: each task appends records, one gzip member each, to archives of its own and returns their
index (archive, offset, length, URL, digest). The index is stored before anything reads the archives,
so what a lost or repeated task left behind is never read.
Reading: selected index rows are dealt out by stretches of the archives and sorted by offset;
near ranges become one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftward.llm.common import byte_slices, cut_lineage, file_system, new_folder, raw, table

ARCHIVE_BYTES = 1 << 30
#: One task reads one stretch of an archive.
STRETCH_BYTES = 64 << 20
#: Ranges so near are read as one, up to the size of a read.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
RECORDS = uuid.UUID("6f2cf1b0-8a0e-5c63-9f0a-3f1d0f3b9a51")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")

INDEX = (
    "archive string, offset long, length long, page_id long, url string, digest string, record_type string"
)
RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORDS, f'{page}:{digest}')}>"


def head(fields: list[tuple[str, object]], block: int) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in fields if v is not None]
    return f"WARC/1.1\r\n{''.join(lines)}Content-Length: {block}\r\n\r\n".encode()


def member(head: bytes, block: bytes) -> bytes:
    """One record as one gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def written(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", page),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", refers_to),
        ]
        return member(head(fields, 0), b"")
    block = HTTP.format(len(payload)).encode() + payload
    return member(head([*fields, ("Content-Type", "application/http; msgtype=response")], len(block)), block)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip member."""
    text = zlib.decompress(data, 31)
    top, _, rest = text.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def planned(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, key: str = "page_id") -> DataFrame:
    """Pages with payload, hex digest and, where an equal payload has a larger id, ``keeper``, that id.

    Digests are counted before the join, so only repeated ones take part in it; a hot payload is one row there.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), raw("html").alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    keepers = (
        rows.where(F.octet_length("payload") >= revisit_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and keeper is not null")
        .select("sha1", "keeper")
    )
    joined = rows.join(cut_lineage(keepers), "sha1", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("keeper")).alias("keeper"))


def write_archives(
    pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES
) -> tuple[str, DataFrame]:
    """Write a record per page; returns the folder and the stored index.

    Of pages with equal payloads of ``revisit_bytes`` or more, the one with the largest id is a response and
    the others revisit it; rows that repeat that id are responses too. A null payload is empty, a null URL
    gives no field, null ids are below all others (and responses if there is no other). Other columns are ignored.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        file, name, at = None, "", 0
        for batch in batches:
            start = 0
            for part in byte_slices(batch.column("payload")):
                rows = batch.slice(start, len(part)).to_pylist()
                start += len(part)
                index = []
                for row in rows:
                    if file is None or at >= archive_bytes:
                        if file is not None:
                            file.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        file = store.open_output_stream(f"{base}/{name}", compression=None)
                        info = b"software: siftward\r\nformat: WARC File Format 1.1\r\n"
                        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
                        data = member(head(fields, len(info)), info)
                        file.write(data)
                        at += len(data)
                    payload, keeper = row["payload"], row["keeper"]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    revisit = keeper is not None
                    data = written(row["page_id"], row["url"], payload, digest, keeper, revisit)
                    file.write(data)
                    index.append({"archive": name, "offset": at, "length": len(data), "page_id": row["page_id"], "url": row["url"], "digest": digest, "record_type": "revisit" if revisit else "response"})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(index, ARROW_INDEX)
        if file is not None:
            file.close()

    return folder, cut_lineage(planned(pages, revisit_bytes).mapInArrow(write, INDEX))


ARROW_INDEX = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
    ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()),
])
ARROW_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])


def coalesced(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted ranges as reads: archive, start, stop, and the (offset, length) of the records in it."""
    archive, start, stop, held = None, 0, 0, []
    for name, offset, length in rows:
        if held and (
            name != archive or offset - stop > GAP_BYTES or offset + length - start > READ_BYTES
        ):
            yield archive, start, stop, held
            held = []
        if not held:
            archive, start = name, offset
        held.append((offset, length))
        stop = offset + length
    if held:
        yield archive, start, stop, held


def read_records(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the selected index rows. Size and digest of a response are those of what was read.

    A revisit has no payload of its own: its digest is the field's, its size null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        file, name = None, None
        ranges = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3))))
        for archive, start, stop, held in coalesced(ranges):
            if archive != name:
                if file is not None:
                    file.close()
                file, name = store.open_input_file(f"{base}/{archive}"), archive
            file.seek(start)
            data = file.read(stop - start)
            rows = []
            for offset, length in held:
                fields, block = parsed(data[offset - start : offset - start + length])
                row = {"record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI")}
                row["page_id"] = int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None
                if row["record_type"] == "revisit":
                    row["refers_to"] = int(fields["X-Refers-To-Page-Id"])
                    row["digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                else:
                    body = block[block.index(b"\r\n\r\n") + 4 :]
                    row["digest"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    row["payload_bytes"] = len(body)
                    if payload:
                        row["payload"] = body
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, ARROW_RECORD)
        if file is not None:
            file.close()

    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    ranges = index.select("archive", "offset", "length", stretch.alias("stretch"))
    ranges = ranges.repartition("archive", "stretch").sortWithinPartitions("archive", "offset")
    return ranges.select("archive", "offset", "length").mapInArrow(read, RECORD)


def page_digests(records: DataFrame) -> DataFrame:
    """Per page the size and digest of its full payload, a revisit's from the response it refers to."""
    rows = records.drop("payload")
    sizes = rows.where("record_type = 'response'").groupBy("digest").agg(F.max("payload_bytes").alias("size"))
    revisited = rows.where("record_type = 'revisit'").join(sizes, "digest", "left")
    columns = ["page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    responses = rows.where("record_type = 'response'").select(*columns)
    return responses.unionByName(revisited.withColumn("payload_bytes", F.col("size")).select(*columns))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives, index = write_archives(table(spark, folder, "pages"))
    return page_digests(cut_lineage(read_records(index, archives, payload=False)))


ORACLE = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
    SELECT hex, max(page_id) AS keeper FROM p GROUP BY hex
), bits AS (
    SELECT hex, keeper, list_transform(range(0, 32), lambda i:
        list_reduce(list_transform(range(0, 5), lambda j:
            ((strpos('0123456789abcdef', substr(hex, CAST((5 * i + j) // 4 + 1 AS BIGINT), 1)) - 1)
                // CAST(2 ** (3 - (5 * i + j) % 4) AS BIGINT)) % 2), lambda a, b: 2 * a + b)) AS quints
    FROM k
), d AS (
    SELECT hex, keeper, list_aggregate(list_transform(quints, lambda q:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(q + 1 AS BIGINT), 1)), 'string_agg', '') AS digest
    FROM bits
)
SELECT p.page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
    CASE WHEN p.page_id = d.keeper THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN p.page_id = d.keeper THEN NULL ELSE d.keeper END AS refers_to
FROM p JOIN d USING (hex)
"""
