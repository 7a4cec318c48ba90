"""Recorded pages as a Spark data source: ``spark.read.format("recorded_pages").load(folder)``.

A recording is a folder of gzip'd JSON-lines files and one manifest for each write, which names the write's files with the
first and the last page in each. Reading is lazy: a file is a partition, and a filter on ``page_id`` that Spark pushes down
leaves out the files that can't have such a page (and rows on reading), before any task starts. Writing follows the commit protocol: files of
failed attempts are in no manifest, and a write that fails leaves none.

The folder is one that driver and executors share as a mount (``file:`` or a plain path).
"""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "page_id bigint, url string, html string"
ROWS = 1000
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def _local(folder: str) -> str:
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"a recording has to be in a mounted folder, not {folder}")
    return unquote(parts.path)


@dataclass
class Recorded(InputPartition):
    """One file, and the pages wanted of it."""

    file: str
    low: int | None
    high: int | None
    among: tuple[int, ...] | None

    def __init__(self, file: str, low: int | None, high: int | None, among: tuple[int, ...] | None):
        super().__init__(file)
        self.file, self.low, self.high, self.among = file, low, high, among

    def wants(self, page: int | None) -> bool:
        if self.low is None and self.high is None and self.among is None:
            return True
        return page is not None and (self.low is None or page >= self.low) and (self.high is None or page <= self.high) and (self.among is None or page in self.among)


class PagesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.low = self.high = self.among = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds and sets of ``page_id``; everything else goes back to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("page_id",) or getattr(f, "value", 0) is None:
                yield f
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan) if not isinstance(f, (LessThan, LessThanOrEqual)) else None
                high = f.value - isinstance(f, LessThan) if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else None
                self.low = low if self.low is None or low is None and self.low is None else max(self.low, low if low is not None else self.low)
                self.high = high if self.high is None else min(self.high, high if high is not None else self.high)
            elif isinstance(f, In):
                own = {v for v in f.value if v is not None}
                self.among = tuple(sorted(own if self.among is None else own & set(self.among)))
            else:
                yield f

    def partitions(self) -> list[Recorded]:
        out = []
        for name in sorted(os.listdir(self.folder)):
            if name.startswith("manifest-"):
                with open(f"{self.folder}/{name}") as f:
                    for x in json.load(f):
                        part = Recorded(f"{self.folder}/{x['file']}", self.low, self.high, self.among)
                        empty = x["first"] is None
                        none = self.low is None and self.high is None and self.among is None
                        outside = empty or (self.low is not None and x["last"] < self.low) or (self.high is not None and x["first"] > self.high) or (self.among is not None and not any(x["first"] <= v <= x["last"] for v in self.among))
                        if none or not outside:
                            out.append(part)
        return out

    def read(self, partition: Recorded | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no partitions
            return
        held: list[dict] = []
        with gzip.open(partition.file, "rt", encoding="utf-8") as lines:
            for line in lines:
                row = json.loads(line)
                if partition.wants(row["page_id"]):
                    held.append(row)
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    first: int | None
    last: int | None
    rows: int


class PagesWriter(DataSourceArrowWriter):
    """Each task writes a file; the manifest of the whole write comes last, in one step."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.old = [n for n in os.listdir(folder) if n.startswith("manifest-")] if os.path.isdir(folder) else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        name = f"pages-{uuid.uuid4().hex}.jsonl.gz"
        first = last = None
        rows = 0
        with gzip.open(f"{self.folder}/{name}", "wt", encoding="utf-8") as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(json.dumps(row, ensure_ascii=False) + "\n")
                    rows += 1
                    if row["page_id"] is not None:
                        first = row["page_id"] if first is None else min(first, row["page_id"])
                        last = row["page_id"] if last is None else max(last, row["page_id"])
        if rows:
            return Written(name, first, last, rows)
        os.remove(f"{self.folder}/{name}")
        return Written(None, None, None, 0)

    def commit(self, messages: list[Written | None]) -> None:
        listed = [{"file": m.file, "first": m.first, "last": m.last, "rows": m.rows} for m in messages if m and m.file]
        os.makedirs(self.folder, exist_ok=True)
        part = f"{self.folder}/.manifest-{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump(listed, f)
        os.replace(part, f"{self.folder}/manifest-{uuid.uuid4().hex}.json")
        if self.overwrite:  # the new pages are there before the old ones go
            for name in self.old:
                os.remove(f"{self.folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.file and os.path.exists(f"{self.folder}/{m.file}"):
                os.remove(f"{self.folder}/{m.file}")


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(_local(self.options["path"]))

    def writer(self, schema: StructType, overwrite: bool) -> PagesWriter:
        if [f.name for f in schema.fields] != ["page_id", "url", "html"]:
            raise ValueError("a recording takes page_id, url and html, in this order")
        return PagesWriter(_local(self.options["path"]), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedPages)
