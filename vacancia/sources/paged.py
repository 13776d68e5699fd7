"""Two Python data sources: captured pages that are read in order until they are old, and one JSON document out of many tasks.

Files are opened through Arrow's file systems, in tasks, so a folder may be in any store that Arrow knows (``file``, ``s3``,
``gs``, ``hdfs`` with its library). Register both with ``register(spark)``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

# Pages a tenant by default and at most, and how much older than the start a page's oldest posting must be.
PAGES, MOST_PAGES = 100, 1500
MARGIN = timedelta(days=2)
CHUNK = 1 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def page_cap(asked: str | None) -> int:
    """How many pages of a tenant are read: a whole number from 1 on, up to the ceiling; else the default."""
    return min(int(asked), MOST_PAGES) if asked and asked.isdigit() and int(asked) > 0 else PAGES


def instant(text: object) -> datetime | None:
    """A time in ISO form (UTC without a zone), or None for anything else, such as an age without a bound."""
    if not isinstance(text, str):
        return None
    try:
        found = datetime.fromisoformat(text)
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def is_old(payload: str, items: str, posted: str, start: datetime | None) -> bool:
    """Whether the oldest dated posting of a page lies before the start by more than the margin."""
    try:
        found = json.loads(payload)
    except ValueError:
        return False
    jobs = found.get(items) if isinstance(found, dict) else found
    dated = [t for j in jobs if isinstance(j, dict) and (t := instant(j.get(posted)))] if isinstance(jobs, list) else []
    return start is not None and bool(dated) and min(dated) < start - MARGIN


@dataclass
class Tenant(InputPartition):
    name: str


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.cap = page_cap(options.get("maxpages"))
        self.start = instant(options.get("since"))
        self.items, self.posted = options.get("items", "jobPostings"), options.get("posted", "postedOn")

    def partitions(self) -> list[Tenant]:
        store, root = open_store(self.path)
        return [Tenant(f.base_name) for f in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda f: f.path) if f.type == fs.FileType.Directory]

    def read(self, partition: Tenant) -> Iterator[tuple]:
        store, root = open_store(self.path)
        names = [f for f in store.get_file_info(fs.FileSelector(f"{root}/{partition.name}")) if f.type == fs.FileType.File and f.base_name.split(".")[0].isdigit()]
        for f in sorted(names, key=lambda f: int(f.base_name.split(".")[0]))[: self.cap]:
            with store.open_input_stream(f.path) as stream:
                payload = stream.read().decode("utf-8")
            yield partition.name, int(f.base_name.split(".")[0]), payload
            if is_old(payload, self.items, self.posted, self.start):
                return


class CapturedPages(DataSource):
    """Pages of postings, newest first, under ``path/<tenant>/<number>.json``: tenant, page and payload, a partition a tenant.

    Reading a tenant ends with the first page whose oldest dated posting is two days older than ``since``, and after
    ``maxPages`` pages; later files aren't opened. ``items`` and ``posted`` name the list and the date in a page. Pages that
    aren't JSON, or have no dates, don't end it.
    """

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return "tenant string, page int, payload string"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader({k.lower(): v for k, v in self.options.items()})


@dataclass
class Part(WriterCommitMessage):
    path: str
    first: str
    rows: int


class EnvelopeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        self.path, self.version = options["path"], int(options.get("version", "1"))
        self.columns, self.overwrite, self.token = columns, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Part:
        """One task's items, JSON texts apart by commas, in a file of its own beside the target."""
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = open_store(self.path)
        part = f"{path}.{self.token}.{context.partitionId():06d}.{context.taskAttemptId()}"
        n = 0
        with store.open_output_stream(part) as out:
            for row in iterator:
                text = json.dumps(dict(zip(self.columns, row, strict=True)), ensure_ascii=False, separators=(",", ":"), default=str)
                out.write((("," if n else "") + text).encode("utf-8"))
                n += 1
        return Part(part, f"{context.partitionId():06d}", n)

    def commit(self, messages: list[Part | None]) -> None:
        """The parts in order, in chunks, into a file that takes the target's name when it is whole."""
        store, path = open_store(self.path)
        whole = f"{path}.{self.token}"
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        with store.open_output_stream(whole) as out:
            out.write(f'{{"schemaVersion":{self.version},"items":['.encode())
            begun = False
            for part in parts:
                if part.rows:
                    out.write(b"," if begun else b"")
                    begun = True
                    with store.open_input_stream(part.path) as stream:
                        while chunk := stream.read(CHUNK):
                            out.write(chunk)
            out.write(b"]}")
        store.move(whole, path)
        self._clean(parts)

    def abort(self, messages: list[Part | None]) -> None:
        self._clean([m for m in messages if m is not None])

    def _clean(self, parts: list[Part]) -> None:
        """This write's own part files, those of failed attempts included."""
        store, path = open_store(self.path)
        folder, _, base = path.rpartition("/")
        known = {p.path for p in parts}
        for f in store.get_file_info(fs.FileSelector(folder or ".")):
            if f.path in known or f.base_name.startswith(f"{base}.{self.token}."):
                store.delete_file(f.path)


class JsonEnvelope(DataSource):
    """One JSON document ``{"schemaVersion": version, "items": [...]}`` of all rows, in the order of partitions; the file is
    there whole or not at all. Its size is one file's: meant for what a run reports, not for a corpus."""

    @classmethod
    def name(cls) -> str:
        return "json_envelope"

    def writer(self, schema: StructType, overwrite: bool) -> EnvelopeWriter:
        return EnvelopeWriter({k.lower(): v for k, v in self.options.items()}, schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    for source in (CapturedPages, JsonEnvelope):
        spark.dataSource.register(source)
