"""Operator 8: WARC records in ZIP packages, read by range without extraction.

An archive is a ZIP file with two stored (uncompressed) members: the WARC file
``archive/data.warc.gz``, one gzip member a record, and the index
``indexes/index.tsv`` with a line (id, offset, length) a record. The reader
parses the end-of-central-directory record, its ZIP64 counterpart and the
central directory, finds the stored members, reads the index, and then reads
only the byte ranges of the records it wants.

Writing and reading are done by tasks through ``pyarrow.fs`` on the shared
folder (``file``, ``hdfs``, ``s3`` and others). Each task attempt writes files
of its own name; only archives of the manifest that Spark committed are read, so
lost executors and repeated tasks leave nothing but unread files.

Edge cases: a null payload is empty; equal payloads of ``MIN_REVISIT`` bytes or
more are stored once, with the smallest id (null last); rows that repeat that
id are responses again; rows without id are recorded with the id ``null`` and
never referred to unless all have none, in which case all are responses; a null
URL has no target line; line ends in a URL are written percent-encoded; without
pages there are no archives. Columns the input has besides are not recorded.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.common import small, table
from tidings.session import checkpoint_root, stage

#: Payloads below this size are never replaced by a revisit.
MIN_REVISIT = 100
#: Bytes of WARC data after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: Records that start within the same so many bytes of an archive are read by the same task.
BLOCK_BYTES = 8 << 20
#: Tasks of a reading pass, at most.
MAX_TASKS = 100_000
#: Ranges nearer to each other than this are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 16 << 10, 4 << 20

DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ReadAt = Callable[[int, int], bytes]


# --- records ---------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"),
            f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: " + REVISIT]
    head += ["WARC-Payload-Digest: sha256:" + digest, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _page(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def parse_record(packed: bytes) -> dict:
    """The fields of a record; digest and size of a response are those of the bytes read."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    named = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {"page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
           "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": None,
           "payload_bytes": declared, "payload_digest": named}
    if out["record_type"] == "response":
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
        if out["payload_digest"] != named or len(payload) != declared:
            raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
    return out


# --- ZIP directories -------------------------------------------------------

def stored_members(read_at: ReadAt, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of its bytes in the archive, their number) of every stored
    member; compressed ones can't be read by range and are left out."""
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    # the record's comment reaches to the end of the file; a look-alike inside a comment doesn't
    while k >= 0 and (k + 22 > len(tail) or k + 22 + int.from_bytes(tail[k + 20:k + 22], "little") != len(tail)):
        k = tail.rfind(b"PK\x05\x06", 0, k)
    if k < 0:
        raise ValueError("no end-of-central-directory record")
    count, length, start = struct.unpack("<HLL", tail[k + 10:k + 20])
    # the ZIP64 locator stands before the record, with a long comment before the tail too
    before = tail_at + k - 20
    locator = read_at(before, 20) if before >= 0 else b""
    if locator[:4] == b"PK\x06\x07":
        end64, = struct.unpack("<Q", locator[8:16])
        count, length, start = struct.unpack("<QQQ", read_at(end64 + 32, 24))
    directory, at, out = read_at(start, length), 0, {}
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[at + 10:at + 12])
        packed, plain, n, extra_n, comment_n = struct.unpack("<LLHHH", directory[at + 20:at + 34])
        header, = struct.unpack("<L", directory[at + 42:at + 46])
        name = directory[at + 46:at + 46 + n].decode("utf-8")
        extra, e = directory[at + 46 + n:at + 46 + n + extra_n], 0
        while e + 4 <= len(extra):
            kind, m = struct.unpack("<HH", extra[e:e + 4])
            if kind == 1:  # ZIP64: the values that don't fit above, in this order
                values = iter(struct.unpack(f"<{m // 8}Q", extra[e + 4:e + 4 + m // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            e += 4 + m
        if method == 0:
            local_n, local_extra = struct.unpack("<HH", read_at(header + 26, 4))
            out[name] = header + 30 + local_n + local_extra, packed
        at += 46 + n + extra_n + comment_n
    return out


# --- writing ---------------------------------------------------------------

def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` and ``refers_to``, the smallest
    id of an equal payload where that is another one."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    out = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    groups = out.where(F.octet_length("payload") >= MIN_REVISIT).groupBy(F.col("digest").alias("_d"))
    shared = stage(groups.agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "shared-payloads")
    out = out.join(small(shared), F.col("digest") == F.col("_d"), "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select("page_id", "url", "payload", "digest", F.when(other, F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as archives below ``root``; the manifest (``path``,
    ``records``, ``bytes``), staged."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        parts = (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64))
        rows = (r for b in parts for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        part, k = TaskContext.get().partitionId(), 0
        row = next(rows, None)
        while row is not None:
            name = f"part-{part:06d}-{k:04d}-{uuid.uuid4().hex[:8]}.zip"
            index, at = [], 0
            with store.open_output_stream(f"{folder}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
                with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                    while row is not None and at < archive_bytes:
                        packed = record(*row)
                        member.write(packed)
                        index.append(f"{'null' if row[0] is None else row[0]}\t{at}\t{len(packed)}\n")
                        at += len(packed)
                        row = next(rows, None)
                z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "records": [len(index)], "bytes": [at]})
            k += 1

    written = with_revisits(pages).mapInArrow(write, "path string, records long, bytes long")
    return stage(written, "warc-manifest")


# --- reading ---------------------------------------------------------------

def _open(uri: str):
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def read_index(manifest: DataFrame) -> DataFrame:
    """A row (``path``, ``at``, ``length``) for each record that the indexes name."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _open(path) as f:
                    members = stored_members(lambda at, n, f=f: f.read_at(n, at), f.size())
                    (data, size), (start, n) = members[DATA], members[INDEX]
                    lines = [x.split("\t") for x in f.read_at(n, start).decode().splitlines()]
                offsets, lengths = [int(x[1]) for x in lines], [int(x[2]) for x in lines]
                if any(o + m > size for o, m in zip(offsets, lengths, strict=True)):
                    raise ValueError(f"{path}: the index points behind the data")
                yield pd.DataFrame({"path": path, "at": [data + o for o in offsets], "length": lengths})

    # a task a few archives, however few bytes their paths have; the manifest is staged
    tasks = max(1, min(manifest.count(), MAX_TASKS))
    return manifest.select("path").repartition(tasks, "path").mapInPandas(entries, "path string, at long, length long")


RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def blocks_of(manifest: DataFrame) -> int:
    """Tasks to read all records of a (staged) manifest: one a block of bytes, since the entries' own size says nothing of it."""
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return max(1, min(-(-total // BLOCK_BYTES), MAX_TASKS))


def read_records(entries: DataFrame, payload: bool = True, tasks: int | None = None) -> DataFrame:
    """The records of the given entries; neighbouring ranges are read at once.
    ``payload=False`` checks the payloads but leaves them out. ``tasks``: how many
    read (:func:`blocks_of`); Spark would size them by the entries, not by what they point to."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, f = None, None
        for batch in batches:
            ranges = list(zip(batch["path"], batch["at"], batch["length"], strict=True))
            k = 0
            while k < len(ranges):
                if ranges[k][0] != path:
                    path = ranges[k][0]
                    f = _open(path)
                j, start, end = k, ranges[k][1], ranges[k][1] + ranges[k][2]
                while (j + 1 < len(ranges) and ranges[j + 1][0] == path and 0 <= ranges[j + 1][1] - end <= GAP_BYTES
                       and ranges[j + 1][1] + ranges[j + 1][2] - start <= READ_BYTES):
                    j += 1
                    end = ranges[j][1] + ranges[j][2]
                raw = f.read_at(end - start, start)
                rows = [parse_record(raw[a - start:a - start + n]) for _, a, n in ranges[k:j + 1]]
                if not payload:
                    for r in rows:
                        r["payload"] = None
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
                k = j + 1

    block = F.floor(F.col("at") / BLOCK_BYTES)
    dealt = entries.repartition(tasks, "path", block) if tasks else entries.repartition("path", block)
    return dealt.sortWithinPartitions("path", "at").mapInPandas(fetch, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), checkpoint_root(spark, "archives"))
    found = read_records(read_index(manifest), payload=False, tasks=blocks_of(manifest))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = f"""
WITH p AS (SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= {MIN_REVISIT} GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url
FROM p LEFT JOIN g ON p.digest = g.digest
"""
