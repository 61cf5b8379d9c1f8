"""WARC archives with a two-level capture index.

Writing: each task appends records, one gzip member each, to archive files of bounded size in the shared folder.
File names are unique to an attempt, and only the manifest table says which files count, so a task that runs
twice leaves an unused file and no second record.

Index: captures are sorted by reversed-host key and page id into shards; a shard is a file of gzip blocks of
index lines, ended by its sparse block directory (the first key and place of each block).  The first level is
the list of shards with their first keys, at most MAX_SHARDS.

Lookup: query keys are range-partitioned and sorted; each is binary-searched in the shard list and then in that
shard's directory, which gives the blocks to read.  Blocks are then dealt out, range-read, binary-searched for
their keys, and the records of those captures are range-read, near ones in one read.  Captures of one key may
fill any number of blocks, and each block is a piece of work of its own.

Records of equal payloads of at least REVISIT_BYTES: the largest page id is the response, all others are revisits
of it, without payload; a revisit's HTTP header keeps the payload's length.

Defined results: a null html is an empty payload; a null or odd url is kept (control characters and spaces
percent-encoded) and has a key; repeated rows make a record each; a page without an id is archived and read back
with a null id, and is a revisit if a page with an id has its payload; a payload may have any length (one record is in
memory at a time); equal payloads have one largest id, so there are no ties; an empty table gives an empty archive;
other columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import Scratch

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
BLOCK_LINES = 1000
MAX_SHARDS = 4096
SHARD_ROWS = 1_000_000
BROADCAST_ROWS = 200_000
#: Records at most this far apart are read together, in reads of at most READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"


def reversed_host(url: str | None) -> str:
    """Sort key of a url: host labels reversed, without scheme, user, www., default port and fragment."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + url
    if not host:
        return ")" + url
    host = re.sub(r"^www\d*\.", "", host.lower().rstrip("."))
    at = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}"
    path = parts.path or "/"
    return ",".join(reversed(host.split("."))) + at + ")" + path + (f"?{parts.query}" if parts.query else "")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's address; any that pyarrow opens (file, s3, gs, hdfs)."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record, uncompressed; digest is hex SHA-1."""
    clean = lambda u: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u or "")
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{i}')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(uuid.uuid4() if page_id is None else page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", *([] if page_id is None else [f"X-Page-Id: {page_id}"])]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Target-URI: {clean(refers_url)}", f"X-Refers-To-Page-Id: {refers_to}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload's digest is checked where the record holds it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of page {fields.get('X-Page-Id')} doesn't match its digest")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    return {"page_id": int(page) if page else None, "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "payload": payload if kind == "response" else None}


MANIFEST = T.StructType([T.StructField("key", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
BLOCK = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("keys", T.ArrayType(T.StringType()))])
CAPTURE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records; the manifest (key, page_id, file, offset, length) comes as a frame that must be written once."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    scratch = Scratch(pages.sparkSession, "warc-equal")
    twice = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("last_url")).where("n > 1").drop("n")
    twice = scratch.put("twice", twice)
    few = twice.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(twice) if few else twice, "digest", "left").withColumn("other", F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id")))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(F.col("other"), F.col("last")).alias("last"), F.when(F.col("other"), F.col("last_url")).alias("last_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                made = {f.name: [] for f in MANIFEST}
                for page, url, payload, digest, last, last_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, payload, digest, last, last_url)) + packer.flush()
                    out.write(member)
                    for k, v in zip(made, (reversed_host(url), page, name, at, len(member)), strict=True):
                        made[k].append(v)
                    at += len(member)
                yield pa.RecordBatch.from_pydict(made, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(run, MANIFEST)


class CaptureIndex:
    """The list of shards: (first key, first page id, file), sorted; everything else stays in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str, shards: list[tuple[str, int, str]]):
        self.spark, self.folder = spark, folder
        self.shards = sorted(shards, key=lambda s: (s[0], s[1] is not None, s[1] or 0, s[2]))

    @staticmethod
    def build(manifest: DataFrame, folder: str, block_lines: int = BLOCK_LINES, shard_rows: int = SHARD_ROWS) -> CaptureIndex:
        shards = max(1, min(MAX_SHARDS, -(-manifest.count() // shard_rows)))
        ordered = manifest.repartitionByRange(shards, "key", "page_id").sortWithinPartitions("key", "page_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = open_fs(folder)
            name, out, at, directory, lines = f"{uuid.uuid4().hex}.cdx", None, 0, [], []

            def flush() -> None:
                nonlocal out, at
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                block = packer.compress("\n".join(json.dumps(x) for x in lines).encode()) + packer.flush()
                directory.append((lines[0][0], lines[0][1], at, len(block)))
                out.write(block)
                at += len(block)
                lines.clear()

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    lines.append(row)
                    if len(lines) == block_lines:
                        flush()
            if lines:
                flush()
            if out is not None:
                tail = zlib.compress(json.dumps(directory).encode())
                out.write(tail + len(tail).to_bytes(8, "big"))
                out.close()
                yield pa.RecordBatch.from_pydict({"key": [directory[0][0]], "page_id": [directory[0][1]], "file": [name]}, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string())]))

        made = ordered.mapInArrow(run, "key string, page_id long, file string").collect()
        return CaptureIndex(manifest.sparkSession, folder, [tuple(r) for r in made])

    def blocks(self, keys: DataFrame) -> DataFrame:
        """(file, offset, length, keys) of the index blocks that may hold the keys (a frame of one column)."""
        folder, shards = self.folder, self.shards
        firsts = [s[0] for s in shards]
        keys = keys.toDF("key").distinct()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = open_fs(folder)
            held: tuple[str, list, list] = ("", [], [])

            def directory(name: str) -> tuple[list, list]:
                nonlocal held
                if held[0] != name:
                    with fs.open_input_file(f"{root}/{name}") as f:
                        size = f.size()
                        tail = int.from_bytes(f.read_at(8, size - 8), "big")
                        found = json.loads(zlib.decompress(f.read_at(tail, size - 8 - tail)))
                    held = (name, found, [x[0] for x in found])
                return held[1:]

            for batch in batches:
                made: dict[tuple[str, int, int], list[str]] = {}
                for key in batch.column(0).to_pylist():
                    if not shards:
                        continue
                    # a key's captures begin in the last shard whose first key is less, and end before the first whose first key is greater
                    for s in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                        found, heads = directory(shards[s][2])
                        for b in range(max(0, bisect.bisect_left(heads, key) - 1), bisect.bisect_right(heads, key)):
                            made.setdefault((shards[s][2], found[b][2], found[b][3]), []).append(key)
                yield pa.RecordBatch.from_pydict({"file": [k[0] for k in made], "offset": [k[1] for k in made], "length": [k[2] for k in made], "keys": list(made.values())}, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("keys", pa.list_(pa.string()))]))

        n = max(1, min(len(shards), 512))
        return keys.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, BLOCK)

    def lookup(self, keys: DataFrame, payloads: bool = True) -> DataFrame:
        """All captures of the keys, read from the archives: CAPTURE rows (payload null for revisits, and without payloads)."""
        folder = self.folder

        def captures(fs, root, file, offset, length, wanted) -> list[tuple]:
            with fs.open_input_file(f"{root}/{file}") as f:
                lines = [json.loads(x) for x in zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")]
            heads, out = [x[0] for x in lines], []
            for key in wanted:
                out += lines[bisect.bisect_left(heads, key) : bisect.bisect_right(heads, key)]
            return sorted(out, key=lambda x: (x[2], x[3]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = open_fs(folder)
            types = pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
            for batch in batches:
                for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found, k = captures(fs, root, *item), 0
                    f, opened = None, ""
                    while k < len(found):
                        _, _, file, start, size = found[k]
                        end, j = start + size, k + 1
                        while j < len(found) and found[j][2] == file and found[j][3] - end <= GAP_BYTES and found[j][3] + found[j][4] - start <= READ_BYTES:
                            end = max(end, found[j][3] + found[j][4])
                            j += 1
                        if file != opened:
                            if f is not None:
                                f.close()
                            f, opened = fs.open_input_file(f"{root}/{file}"), file
                        data = f.read_at(end - start, start)
                        rows = []
                        for key, _, _, o, n in found[k:j]:
                            x = parse(zlib.decompress(data[o - start : o - start + n], 31))
                            rows.append(x | {"key": key} | ({} if payloads else {"payload": None}))
                        yield pa.RecordBatch.from_pylist(rows, schema=types)
                        k = j
                    if f is not None:
                        f.close()

        return self.blocks(keys).repartition(max(8, 4 * len(self.shards))).mapInArrow(run, CAPTURE)


def keys_of(urls: DataFrame) -> DataFrame:
    """The reversed-host keys of a frame of one column of urls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([reversed_host(u) for u in batch.column(0).to_pylist()], pa.string())})

    return urls.mapInArrow(run, "key string")


def archive(pages: DataFrame, **options) -> tuple[CaptureIndex, DataFrame]:
    """Writes pages as an indexed archive in the shared folder; gives the index and the manifest table."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.path}/archive"
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    manifest = scratch.put("manifest", write_archive(pages, folder, **options))
    return CaptureIndex.build(manifest, folder), manifest
