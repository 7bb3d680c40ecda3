"""Web archives with a two-level capture index.

Archives are gzip members, one per record, so a record is read by its range of
bytes. The index has the captures sorted by reversed-host key, in blocks of
lines that are compressed on their own, and a directory with the first key of
every block. Index and archives are files in a folder that all executors reach,
opened through the file system of its address.

A lookup finds its index file by the first keys of the files (as many as there
were shuffle partitions, so they may be broadcast), its blocks by binary search
in the directory of that file, and its lines by binary search in the blocks;
then records are read by ranges, those that lie together in one request.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logrisk.llm.common import lower_ascii, stage_folder, stored

#: Lines of an index block.
LINES = 512
#: Bytes of an archive before the next one is begun.
ARCHIVE = 256 << 20
#: Ranges closer than this are read together, up to GROUP bytes.
GAP, GROUP = 64 << 10, 8 << 20
#: Characters of a key; a longer one ends with the digest of the whole.
KEY = 1_000

CAPTURE = ("key string, page_id long, url string, payload_digest string, payload_bytes long, record_type string, "
           "refers_to long, archive string, offset long, length long")


def surt(url: Column) -> Column:
    """Reversed-host key of a url: com,example,www)/path?query in lower case without scheme, `www.` kept."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), r"(?s)#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    # A line of the index is a line of text.
    key = F.regexp_replace(key, r"[\x00-\x20\x7f]", "_")
    return F.when(F.length(key) > KEY, F.concat(F.substring(key, 1, KEY - 64), F.sha2(key, 256))).otherwise(key)


def base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


# ------------------------------------------------------------------ archives

def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit holds the head of the answer without the payload."""
    target = re.sub(r"[\r\n]+", " ", url or "")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, headers of its answer, and payload."""
    raw = gzip.decompress(member)
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in top.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    head, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), payload


def _written(folder: str, archive_bytes: int):
    """Writes the records of a task to archives of its own, named anew at each attempt, and gives their captures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for key, page_id, url, html, kind, refers_to in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (html or "").encode()
                    digest = base32(hashlib.sha1(payload).digest())
                    member = record(kind, page_id, url, payload, digest, refers_to)
                    out.write(member)
                    rows.append((key, page_id, url, digest, len(payload), kind, refers_to, name, at, len(member)))
                    at += len(member)
                yield _captures(rows)
        finally:
            if out is not None:
                out.close()
    return run


_FIELDS = [("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()),
           ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
           ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])


def typed(pages: DataFrame) -> DataFrame:
    """key, page_id, url, html, record_type, refers_to: the row with the largest id answers for its payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    # Counted before the shuffle and stored, so that AQE can split the rows of a common payload.
    last = stored(rows.groupBy("digest").agg(F.max("page_id").alias("last")), "warc-last")
    joined = rows.join(last, "digest")
    answers = F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select(surt(F.col("url")).alias("key"), "page_id", "url", "html",
                         F.when(answers, "response").otherwise("revisit").alias("record_type"),
                         F.when(~answers, F.col("last")).alias("refers_to"))


# ------------------------------------------------------------------ index

SHARD = "shard string, first_key string, first_id long, blocks long, bytes long"


def _indexed(folder: str, lines: int):
    """Writes the sorted captures of a task as one index file: blocks, then directory, then its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        name, out, at, held, directory = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def flush() -> None:
            nonlocal at, out
            if out is None:
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            block = zlib.compress("\n".join(json.dumps(r) for r in held).encode())
            directory.append([held[0][0], _rank(held[0][1]), at, len(block)])
            out.write(block)
            at += len(block)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) >= lines:
                    flush()
        if held:
            flush()
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (name, directory[0][0], directory[0][1], len(directory), at)],
                ["shard", "first_key", "first_id", "blocks", "bytes"])
    return run


def _rank(page_id: int | None) -> int:
    return -(1 << 63) if page_id is None else page_id


@dataclass
class Archive:
    """What was written: the folder, and the index files with their first keys."""

    spark: SparkSession
    folder: str
    captures: DataFrame
    shards: DataFrame

    def first_keys(self) -> list[tuple[str, int, str]]:
        """One entry per index file, in order; at most as many as shuffle partitions, keys of bounded length."""
        return sorted((r.first_key, r.first_id, r.shard) for r in self.shards.collect())

    def lookup(self, wanted: DataFrame, exact: bool = True) -> DataFrame:
        """Captures of the wanted (key, page_id), or of all captures of the wanted keys if not `exact`.

        Wanted rows are made different first. Repeated captures all come back.
        """
        ends = self.spark.sparkContext.broadcast(self.first_keys())
        folder = f"{self.folder}/index"
        wanted = wanted.select("key", "page_id" if exact else F.lit(None).cast("long").alias("page_id")).distinct()
        dealt = wanted.mapInArrow(_dealt(ends, exact), "shard string, key string, page_id long")
        sorted_rows = dealt.repartition("shard").sortWithinPartitions("shard", "key", "page_id")
        return sorted_rows.mapInArrow(_found(folder, exact), CAPTURE)

    def fetch(self, captures: DataFrame) -> DataFrame:
        """The captures read from the archives: capture columns, found_type, found_digest, found_bytes, found_refers_to, payload."""
        group = F.floor(F.col("offset") / F.lit(GROUP)).alias("group")
        dealt = captures.select(*[n for n, _ in _FIELDS], group).repartition("archive", "group")
        dealt = dealt.sortWithinPartitions("archive", "offset").drop("group")
        extra = ", found_type string, found_digest string, found_bytes long, found_refers_to long, payload binary"
        return dealt.mapInArrow(_fetched(f"{self.folder}/archives"), CAPTURE + extra)


def write(pages: DataFrame, archive_bytes: int = ARCHIVE, lines: int = LINES) -> Archive:
    """Archives and capture index of pages in a new folder of the shared one.

    pages: page_id, url, html (further columns are not read). Null html is an
    empty payload, null url an empty key. Of equal payloads the largest page_id
    is the response and the others are revisits of it; rows that repeat this id
    are responses too; null ids come last. Each attempt of a task writes files
    of its own names, and only files named by the stored captures are read, so
    a repeated task does no harm. An empty table gives an index without files.
    """
    spark = pages.sparkSession
    folder = stage_folder(spark, "warc")
    written = typed(pages).mapInArrow(_written(f"{folder}/archives", archive_bytes), CAPTURE)
    captures = stored(written, "warc-captures")
    ordered = captures.repartitionByRange("key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")
    shards = stored(ordered.mapInArrow(_indexed(f"{folder}/index", lines), SHARD), "warc-shards")
    return Archive(spark, folder, captures, shards)


def _dealt(ends, exact: bool):
    """For each wanted key the index files that may hold it: by binary search of their first keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [(k, i) for k, i, _ in ends.value]
        names = [n for _, _, n in ends.value]
        for batch in batches:
            rows = []
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = ((key, _rank(page_id)),) * 2 if exact else ((key, -(1 << 63)), (key, 1 << 63))
                start, stop = max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high)
                rows += [(n, key, page_id) for n in names[start:stop]]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
                ["shard", "key", "page_id"])
    return run


class _Index:
    """One index file: its directory, and the block read last."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        end = self.file.size()
        size = int.from_bytes(self._range(end - 8, 8), "little")
        self.directory = json.loads(zlib.decompress(self._range(end - 8 - size, size)))
        self.firsts = [(k, i) for k, i, _, _ in self.directory]
        self.block, self.lines, self.keys = -1, [], []

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _read(self, block: int) -> None:
        if block != self.block:
            _, _, at, size = self.directory[block]
            self.lines = [json.loads(x) for x in zlib.decompress(self._range(at, size)).split(b"\n")]
            self.keys = [(r[0], _rank(r[1])) for r in self.lines]
            self.block = block

    def find(self, low: tuple, high: tuple) -> Iterator[list]:
        """Lines between two keys, both included."""
        start = max(0, bisect_left(self.firsts, low) - 1)
        for block in range(start, bisect_right(self.firsts, high)):
            self._read(block)
            yield from self.lines[bisect_left(self.keys, low):bisect_right(self.keys, high)]


def _found(folder: str, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        name, index = None, None
        for batch in batches:
            rows = []
            for shard, key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != name:
                    name, index = shard, _Index(files, f"{root}/{shard}")
                ends = ((key, _rank(page_id)),) * 2 if exact else ((key, -(1 << 63)), (key, 1 << 63))
                for line in index.find(*ends):
                    rows.append(line)
                    if len(rows) >= 10_000:
                        yield _captures(rows)
                        rows = []
            yield _captures(rows)
    return run


def _fetched(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        name, file = None, None

        def together(rows: list) -> pa.RecordBatch:
            """Rows of one archive that lie close by, read in one range."""
            nonlocal name, file
            if rows[0][7] != name:
                name, file = rows[0][7], files.open_input_file(f"{root}/{rows[0][7]}")
            begin = rows[0][8]
            file.seek(begin)
            raw = file.read(max(r[8] + r[9] for r in rows) - begin)
            found = []
            for r in rows:
                fields, head, payload = parsed(raw[r[8] - begin:r[8] - begin + r[9]])
                refers = fields.get("X-Refers-To-Page-ID")
                found.append((fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                              int(head["Content-Length"]), None if refers in (None, "None") else int(refers), payload))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            part = _captures(rows)
            names = [*part.schema.names, "found_type", "found_digest", "found_bytes", "found_refers_to", "payload"]
            return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names)

        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[7] != held[0][7] or row[8] - held[-1][8] - held[-1][9] > GAP or row[8] - held[0][8] > GROUP):
                    yield together(held)
                    held = []
                held.append(row)
        if held:
            yield together(held)
    return run


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages, looks every one up in the index and reads it back.

    One row per page: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, archive, offset. Bytes and digest of a response are those of the
    payload that was read; a revisit gives those it states for the full payload.
    """
    made = write(pages)
    read = made.fetch(made.lookup(made.captures))
    return read.select(
        "page_id", "url",
        F.when(F.col("found_type") == "response", F.length("payload").cast("long")).otherwise(F.col("found_bytes")).alias("payload_bytes"),
        F.when(F.col("found_type") == "response", _base32_sha1(F.col("payload"))).otherwise(F.col("found_digest")).alias("payload_digest"),
        F.col("found_type").alias("record_type"), F.col("found_refers_to").alias("refers_to"), "archive", "offset")


def _base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 of the SHA-1: 160 bits in 32 groups of 5, each from a byte and its neighbour."""
    bits = F.sha1(payload)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = []
    for group in range(32):
        at = group * 5
        # Three hexadecimal digits hold any group of five bits.
        start = min(at // 4, 37)
        number = F.conv(F.substring(bits, start + 1, 3), 16, 10).cast("int")
        digits.append(F.substring(F.lit(letters), F.shiftright(number, 12 - (at - 4 * start) - 5).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*digits)
