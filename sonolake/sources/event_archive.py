"""An archive of events as a sink, for batches and streams: one JSON object for each event, named by its key.

A name depends on the event alone, so a task or batch that runs again puts the same objects. Each attempt of a task lists its objects
and which of them were not there before it; when its batch is given up, those are deleted (a task that ends later leaves its own to
the next run of the batch). The lists of a committed batch are kept next to the archive, in `.lists`: readers take the names from
there, so no listing of the folder goes through the driver. A committed micro-batch leaves a mark with its number. One stream writes
to an archive at a time. Rows without a key are named by a hash of their content.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from sonolake.sources import objects, tables
from sonolake.sources.observations import HOT_EVENT

_LISTED = "name string, new boolean"


@dataclass
class Attempt(WriterCommitMessage):
    """Where an attempt lists its objects, and how many events it archived."""

    listed: str
    n: int


def _plain(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value) if isinstance(value, decimal.Decimal) else value


class _Archive:
    def __init__(self, root: str, key: str):
        self.root, self.key = root.rstrip("/"), key

    def write(self, rows: Iterator[Row]) -> Attempt:
        system, base = objects.place(self.root)
        listed, names = f"{self.root}/_attempts/{uuid.uuid4().hex}.json", []
        try:
            with objects.drafts(self.root) as own:
                for row in rows:
                    fields = row.asDict(recursive=True)
                    name = fields.pop(self.key, None)
                    body = json.dumps({k: _plain(v) for k, v in fields.items() if v is not None}, ensure_ascii=False, sort_keys=True).encode()
                    name = name if name is not None else hashlib.sha256(body).hexdigest()[:32]
                    names.append((f"{name}.json", system.get_file_info(f"{base}/{name}.json").type == fs.FileType.NotFound))
                    objects.put(f"{self.root}/{name}.json", body, own)
        except BaseException:
            self._delete([name for name, new in names if new])
            raise
        objects.put(listed, "\n".join(json.dumps({"name": name, "new": new}) for name, new in names).encode())
        return Attempt(listed, len(names))

    def _delete(self, names: list[str]) -> None:
        system, base = objects.place(self.root)
        for name in names:
            if system.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                system.delete_file(f"{base}/{name}")

    def settle(self, messages: list[Attempt | None], kept: bool) -> int:
        """Ends a batch: its lists are kept for readers, or go with the new objects that they name. The events archived."""
        n = 0
        for m in messages:
            if m is None:  # a task that failed has cleaned up itself
                continue
            system, path = objects.place(m.listed)
            if system.get_file_info(path).type == fs.FileType.File:
                if kept:
                    objects.copy(m.listed, f"{self.root}.lists/{m.listed.rpartition('/')[2]}")
                else:
                    lines = (json.loads(x) for x in objects.get(m.listed).decode().split("\n") if x)
                    self._delete([x["name"] for x in lines if x["new"]])
                system.delete_file(path)
            n += m.n
        return n


class _Batch(_Archive, DataSourceWriter):
    def commit(self, messages) -> None:
        self.settle(messages, True)

    def abort(self, messages) -> None:
        self.settle(messages, False)


class _Stream(_Archive, DataSourceStreamWriter):
    def _mark(self, batch: int) -> str:
        return f"{self.root}/_commits/{batch}"

    def commit(self, messages, batchId: int) -> None:
        n = self.settle(messages, True)
        self._forget()
        objects.put(self._mark(batchId), json.dumps({"batch": batchId, "events": n}).encode())

    def _forget(self) -> None:
        """Lists of attempts that ended after their batch had been given up; the batch that is now committed put the same objects."""
        system, base = objects.place(f"{self.root}/_attempts")
        for left in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            system.delete_file(left.path)

    def abort(self, messages, batchId: int) -> None:
        system, path = objects.place(self._mark(batchId))
        committed = system.get_file_info(path).type == fs.FileType.File  # then its objects are another attempt's
        self.settle(messages, committed)


class EventArchive(DataSource):
    """spark.dataSource.register(EventArchive); events.write.format("event_archive").option("key", "uuid").mode("append").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return "event_archive"

    def _of(self, kind):
        return kind(self.options["path"], self.options.get("key", "uuid"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return self._of(_Batch)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return self._of(_Stream)


def _events(names: DataFrame, root: str) -> DataFrame:
    """The hot events of named objects and the file of each; tasks read the objects."""

    def read(own: pd.Series) -> pd.Series:
        return pd.Series([objects.get(f"{root}/{name}").decode(errors="replace") for name in own], dtype=object)

    text = F.pandas_udf(read, StringType()).asNondeterministic()("name")
    found = names.select(F.concat(F.lit(f"{root}/"), "name").alias("file"), F.from_json(text, HOT_EVENT).alias("e"))
    return found.select("e.*", "file")


def archived(spark: SparkSession, root: str) -> DataFrame:
    """Hot events that committed batches have archived, once each, and the file of each; an archive that is not there is empty."""
    root = root.rstrip("/")
    if not tables.exists(spark, f"{root}.lists"):
        return spark.createDataFrame([], f"{HOT_EVENT}, file string")
    return _events(objects.spread(spark.read.schema(_LISTED).json(f"{root}.lists").select("name"), "name").distinct(), root)


def archived_stream(spark: SparkSession, root: str) -> DataFrame:
    """As archived(), as a stream of what batches archive; an event archived by several batches comes with each."""
    root = root.rstrip("/")
    return _events(objects.spread(spark.readStream.schema(_LISTED).json(f"{root}.lists").select("name"), "name"), root)
