"""WARC archives with a two-level capture index.

Each task writes its rows as gzip members, one record each, to archives of ARCHIVE bytes in the shared
folder, and returns where each record lies. Keys are URLs with the host reversed and a page's id. They are
sorted by range into blocks of LINES lines, and a block is stored compressed. The directory is sparse: the
first key of each block. Reading back is a binary search in the directory, one in the block, and a range
read of the record. LINES grows with the table so that a directory never has more than DIRECTORY entries;
this bounds what is broadcast.

Equal payloads are found by digest before anything is written: that with the largest page_id is a response,
others revisit it. An archive is written under a name of its own and counts only if a row of the committed
location table names it, so a task that is run again leaves no half a record behind.

Defined results: null html is the empty payload, a null url the empty key; of equal payloads in rows of one page_id, or
of none, each row with the largest id is a response; records keep apart by their place, so each row comes back once; a null
page_id is never one to refer to, and with none but such every one is a response; an empty table gives an empty
archive; other columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, qualified, small_batches, staged, tidied
from .linededup import as_bytes

ARCHIVE = 64 << 20
LINES = 500
DIRECTORY = 1 << 16
MIN_REVISIT = 0
#: The date of every record; a run is to give the same bytes again.
DATE = "2024-01-01T00:00:00Z"
_LEVEL = 1
_ESCAPED = re.compile(r"[\x00-\x20\x7f]")


def surt(url: str | None) -> str:
    """The key of a URL: host labels reversed, then the rest; scheme, www and default port are left out."""
    url = url or ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    named = "" if port in (None, 80, 443) else f":{port}"
    rest = parts.path + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")
    return ",".join(reversed(host.split("."))) + named + ")" + (rest or "/")


def sha1_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but its digest and what it refers to."""
    url = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    body = b"" if revisit else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    named = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {named(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {named(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, those of its HTTP block, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record: {version[:20]}")
    own = fields(lines)
    block = rest[: int(own["content-length"])]
    if len(block) != int(own["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, fields(http.decode().split("\r\n")[1:]), payload


def _named(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


_PLACES = "key string, page_id long, archive string, offset long, length long"


def _writer(folder: str):
    names = [x.split()[0] for x in _PLACES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        out, name, offset = None, "", 0
        for b in batches:
            rows = []
            for page, url, payload, keeper, is_copy in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if out is None or offset > ARCHIVE:
                    if out:
                        out.close()
                    fs.create_dir(root)
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = gzip.compress(record(page, url, payload, sha1_digest(payload), keeper, bool(is_copy)), _LEVEL, mtime=0)
                out.write(data)
                rows.append((f"{surt(url)} {'' if page is None else page}", page, name, offset, len(data)))
                offset += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names)
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of ``page_id, url, html``; gives back ``key, page_id, archive, offset, length``."""
    small_batches(pages.sparkSession, 500)
    folder = qualified(pages.sparkSession, folder)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # Digests decide before records are written. The join's right side has payloads that occur twice only, and is
    # staged, so that it is broadcast if small and a hot payload's rows can be split if not.
    sums = staged(pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("d"), F.octet_length("html").alias("n")), "warc-digests")
    shared = staged(sums.where(F.col("n") >= MIN_REVISIT).groupBy("d").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("c")).where("c > 1").select("d", "keeper"), "warc-shared")
    copies = pages.withColumn("d", F.sha1(F.col("html").cast("binary"))).join(shared, "d", "left")
    is_copy = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return staged(copies.select("page_id", "url", "html", "keeper", is_copy.alias("is_copy")).mapInArrow(tidied(_writer(folder)), _PLACES), "warc-places")


_BLOCKS = "first string, part int, block int, lines long, data binary"


def _pack(lines: int):
    names = [x.split()[0] for x in _BLOCKS.split(", ")]

    def batch(rows: list[tuple], part: int, block: int) -> pa.RecordBatch:
        data = zlib.compress("\n".join("\t".join(map(str, r[:1] + r[2:])) for r in rows).encode(), 6)
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(rows)]), pa.array([data], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held = TaskContext.get().partitionId(), 0, []
        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(held) >= lines:
                yield batch(held[:lines], part, block)
                held, block = held[lines:], block + 1
        if held:
            yield batch(held, part, block)

    return run


def build_index(places: DataFrame) -> DataFrame:
    """Blocks in order of keys: ``first, part, block, lines, data``."""
    rows = places.count()
    lines = max(LINES, -(-rows // (DIRECTORY // 2)))
    escaped = F.regexp_replace("key", r"[\t\n]", " ")
    ordered = places.withColumn("key", escaped).repartitionByRange("key").sortWithinPartitions("key", "archive", "offset")
    return staged(ordered.mapInArrow(_pack(lines), _BLOCKS), "cdx")


class Directory:
    """First keys of all blocks, in order: at most DIRECTORY of them and one for each partition."""

    def __init__(self, blocks: DataFrame) -> None:
        rows = sorted(tuple(r) for r in blocks.select("first", "part", "block").collect())
        self.first, self.place = [r[0] for r in rows], [(r[1], r[2]) for r in rows]

    def blocks_of(self, key: str) -> list[tuple[int, int]]:
        """Blocks that may hold a key: the last that begins before it, and those that begin with it."""
        if not self.first:
            return []
        at = bisect_right(self.first, key) - 1
        low = max(at, 0)
        while low > 0 and self.first[low] == key:
            low -= 1
        return self.place[low : max(at, 0) + 1]


_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _range_reader(folder: str, payloads: bool):
    def run(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        fs, root = filesystem(folder)
        data = blocks.column("data")
        lines = zlib.decompress(data[0].as_py()).decode().split("\n") if len(data) else []
        keys = [x.split("\t", 1)[0] for x in lines]
        places: set[tuple[str, int, int]] = set()
        for key in wanted.column("key").to_pylist():
            at = bisect_right(keys, key) - 1
            while at >= 0 and keys[at] == key:
                _, archive, offset, length = lines[at].split("\t")
                places.add((archive, int(offset), int(length)))
                at -= 1
        rows, opened = [], ("", None)
        for archive, offset, length in sorted(places):
            if opened[0] != archive:
                if opened[1]:
                    opened[1].close()
                opened = (archive, fs.open_input_file(f"{root}/{archive}"))
            own, http, payload = parse(gzip.decompress(opened[1].read_at(length, offset)))
            revisit = own["warc-type"] == "revisit"
            if not revisit and f"sha1:{sha1_digest(payload)}" != own["warc-payload-digest"]:
                raise ValueError(f"the payload of {own['warc-record-id']} differs from its digest")
            digest, refers_to = own["warc-payload-digest"].removeprefix("sha1:"), _named(own.get("warc-refers-to"))
            page, size, kept = _named(own["warc-record-id"]), int(http["content-length"]), payload if payloads and not revisit else None
            rows.append((page, size, digest, own["warc-type"], refers_to, kept))
        if opened[1]:
            opened[1].close()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def read_back(blocks: DataFrame, keys: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the captures that ``keys`` (``key``) name, each once."""
    spark: SparkSession = blocks.sparkSession
    folder = qualified(spark, folder)
    directory = spark.sparkContext.broadcast(Directory(blocks))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *p) for k in b.column(0).to_pylist() for p in directory.value.blocks_of(k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["key", "at_part", "at_block"])

    routed = keys.select(F.regexp_replace("key", r"[\t\n]", " ").alias("key")).distinct().mapInArrow(route, "key string, at_part int, at_block int")
    return blocks.select("part", "block", "data").groupBy("part", "block").cogroup(routed.groupBy("at_part", "at_block")).applyInArrow(_range_reader(folder, payloads), _FOUND)


def archive(pages: DataFrame) -> DataFrame:
    """Writes all pages, indexes them, and reads each back by its key."""
    folder = fresh_path(pages.sparkSession, "warc")
    places = write_archives(pages, folder)
    return read_back(build_index(places), places.select("key"), folder)
