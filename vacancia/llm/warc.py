"""WARC archives with a two-level capture index: written by tasks, found by URL key, read back by byte range.

Archives are gzip WARC/1.1 files of one member a record, in a folder that driver and executors share. Of records with
equal payloads the one of the smallest page_id is a response, the others are revisits that refer to it. A task that
runs again writes new files; the index names only those of the attempt that Spark committed.

The index has two levels. Captures are sorted by reversed-host URL key and page_id over range partitions; a partition's
entries lie in a file of its own in compressed blocks of ``BLOCK`` lines. The directory, a small table, has each block's
first key, file, offset and length. A lookup is dealt to its part of the directory by the parts' first keys (a row a
part), finds the block by binary search, reads that range of the index file, decompresses it and searches it. What it
finds is an archive, an offset and a length, read as ranges in file order.

Payloads that a thousandth of the pages share, or more, are a thousand at most and found by broadcast; the others are
joined by digest.

Defined cases: page_id is an integer. A null html counts as empty; one of any length is a record of its own. A null url
has the empty key. Rows that repeat a page_id with the same
payload are records of the same type each; a null page_id is a revisit where another page has its payload and a
response otherwise. Line breaks in a URL are percent-encoded. An empty table writes no archive and gives no rows.
Columns beside page_id, url and html are left out, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import new_folder, slices, utf8, written

BLOCK = 512
FILE_BYTES = 64 << 20
HOT = 1000
DATE = "1970-01-01T00:00:00Z"
# Fixed value: the profile of revisits that share a payload's digest, as the WARC standard names it.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, then the rest: ``com,example)/path?query``."""
    rest = (url or "").strip().split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    name, _, port = host.rpartition("@")[2].lower().partition(":")
    key = ",".join(reversed(name.removeprefix("www.").split(".")))
    return f"{key}{':' + port if port not in ('', '80', '443') else ''}){slash}{path}" if rest else ""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, which holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""

    def headers(part: bytes) -> dict[str, str]:
        lines = part.decode("utf-8", "surrogatepass").split("\r\n")[1:]
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}

    head, _, rest = data.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, wbits=31)
    return packer.compress(data) + packer.flush()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{os.path.abspath(uri)}")


def typed(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``first``: the smallest page_id with the same payload, null where that is of no matter."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    keyed = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    shared = written(keyed, "warc-payloads")
    hot = F.col("n") >= F.lit(max(pages.count() // HOT, 2))
    marked = rows.join(F.broadcast(shared.where(hot).select("digest", F.col("first").alias("hot"))), "digest", "left")
    known = marked.where("hot is not null").select("page_id", "url", "html", F.col("hot").alias("first"))
    rest = marked.where("hot is null").drop("hot").join(shared.where(~hot).select("digest", "first"), "digest", "left").select("page_id", "url", "html", "first")
    return known.unionByName(rest)


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes archives into ``folder``; returns their captures: key, page_id, file, offset, length."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        name, out, at = "", None, 0
        part = TaskContext.get().partitionId()
        try:
            for batch in slices(batches, "html"):
                found = []
                for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    data = _member(record(page_id, url, utf8(html), None if first is None or first == page_id else first, date))
                    out.write(data)
                    found.append((url_key(url), page_id, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), batch.schema.field("page_id").type, pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "file", "offset", "length"]
                )
        finally:
            if out is not None:
                out.close()

    captures = typed(pages, least_bytes).mapInArrow(run, f"key string, page_id {kind}, file string, offset long, length long")
    return written(captures.withColumn("file", F.concat(F.lit(folder + "/"), "file")), "warc-captures")


def index(captures: DataFrame, block: int = BLOCK, partitions: int | None = None, folder: str | None = None) -> DataFrame:
    """Writes the capture index; returns its directory: part, nth, first (key), entries, file, offset, length.

    The files hold blocks of ``block`` sorted lines each, compressed, one behind the other.
    """
    n = partitions or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or new_folder(captures.sparkSession, "warc-index")
    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        part, nth, lines, at = TaskContext.get().partitionId(), 0, [], 0
        name, out = f"part-{part:05d}-{uuid.uuid4().hex}.idx", None

        def block_of(some: list[list]) -> tuple:
            nonlocal out, at, nth
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress("\n".join(map(json.dumps, some)).encode(), 6)
            out.write(data)
            found = (part, nth, some[0][0], len(some), f"{folder}/{name}", at, len(data))
            at, nth = at + len(data), nth + 1
            return found

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["part", "nth", "first", "entries", "file", "offset", "length"])

        try:
            for batch in batches:
                lines += map(list, zip(*(c.to_pylist() for c in batch.columns), strict=True))
                full = len(lines) // block * block
                if full:
                    yield rows([block_of(lines[k : k + block]) for k in range(0, full, block)])
                    lines = lines[full:]
            if lines:
                yield rows([block_of(lines)])
        finally:
            if out is not None:
                out.close()

    directory = ordered.select("key", "page_id", "file", "offset", "length").mapInArrow(run, "part int, nth int, first string, entries int, file string, offset long, length long")
    return written(directory, "warc-directory")


def lookup(directory: DataFrame, keys: DataFrame, group_keys: int = 100_000) -> DataFrame:
    """Captures of each distinct ``key`` of ``keys``: key, page_id, file, offset, length.

    Keys meet their part's directory, not its blocks, in groups of about ``group_keys``. The blocks that the binary search
    names are read by range, each by one task, so that a key of many blocks is searched by many tasks.
    """
    # One row a partition of the index; their number is a setting, not the data's size. Keys compare as UTF-8 bytes.
    first = sorted((r["first"].encode("utf-8", "surrogatepass"), r["part"]) for r in directory.groupBy("part").agg(F.min("first").alias("first")).collect())
    begins, parts = [k for k, _ in first], [p for _, p in first]
    asked = written(keys.select("key").where("key is not null").distinct(), "warc-asked")
    salts = max(1, asked.count() // (max(len(parts), 1) * group_keys))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, salt in zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), strict=True):
                data = utf8(key)
                # A key that many captures share may fill several partitions: from the one before its first on.
                low, high = max(bisect.bisect_left(begins, data) - 1, 0), bisect.bisect_right(begins, data)
                found += [(parts[i], salt, key) for i in range(low, high)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string())], ["part", "salt", "key"])

    def search(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = []
        if blocks.num_rows and wanted.num_rows:
            blocks = blocks.sort_by("nth")
            begin = [utf8(k) for k in blocks.column("first").to_pylist()]
            places = list(zip(*(blocks.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for key in wanted.column("key").to_pylist():
                raw = utf8(key)
                rows += [(key, *places[i]) for i in range(max(bisect.bisect_left(begin, raw) - 1, 0), bisect.bisect_right(begin, raw))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, at, entries, names = None, None, None, [], []
        for batch in batches:
            rows = []
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                if file != opened:
                    if source is not None:
                        source.close()
                    store, path = _open(file)
                    opened, source, at = file, store.open_input_file(path), None
                if offset != at:
                    entries = [json.loads(x) for x in zlib.decompress(source.read_at(length, offset)).split(b"\n")]
                    names, at = [utf8(e[0]) for e in entries], offset
                raw = utf8(key)
                rows += entries[bisect.bisect_left(names, raw) : bisect.bisect_right(names, raw)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "page_id", "file", "offset", "length"])
        if source is not None:
            source.close()

    salted = asked.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).mapInArrow(route, "part int, salt int, key string")
    copies = directory.select("part", "nth", "first", "file", "offset", "length", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    addressed = copies.groupBy("part", "salt").cogroup(salted.groupBy("part", "salt")).applyInArrow(search, "key string, file string, offset long, length long")
    n = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = addressed.repartition(n, "file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(scan, "key string, page_id long, file string, offset long, length long")


def read(located: DataFrame, with_payload: bool = False, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """Records at the given places: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def identifier(value: str | None) -> int | None:
        text = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "None") else None

    def row(data: bytes) -> tuple:
        warc, http, payload = parse(data)
        revisit = warc["warc-type"] == "revisit"
        size, digest = (int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")) if revisit else (len(payload), digest_of(payload))
        found = (identifier(warc["warc-record-id"]), warc["warc-target-uri"], size, digest, warc["warc-type"], identifier(warc.get("warc-refers-to")))
        return (*found, payload) if with_payload else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(places):
                file, begin, size = places[i]
                j, end = i + 1, begin + size
                while j < len(places) and places[j][0] == file and places[j][1] <= end + gap and places[j][1] + places[j][2] - begin <= most:
                    end, j = max(end, places[j][1] + places[j][2]), j + 1
                if file != name:
                    if source is not None:
                        source.close()
                    store, path = _open(file)
                    name, source = file, store.open_input_file(path)
                data = source.read_at(end - begin, begin)
                rows = [row(zlib.decompress(data[o - begin : o - begin + n], wbits=31)) for _, o, n in places[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                i = j
        if source is not None:
            source.close()

    n = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = located.select("file", "offset", "length").repartition(n, "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages``, indexes the captures, looks every URL key up and reads what the index names."""
    captures = write(pages, least_bytes=least_bytes)
    return read(lookup(index(captures), captures))
